import os
import random

import pytest
from pyspark.sql import functions as F

from contigloom.functions import banded
from contigloom.functions import cigar as cg
from contigloom.functions import intervals as iv
from contigloom.functions import sequence as sq
from contigloom.operators import coverage, edges, kmers, reads, regions, stats
from contigloom.sinks import textfiles as sink
from contigloom.sources import bam, bam_index, sam_header, textfiles


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_cigar(spark):
    c = cg.parse_cigar(F.lit("5S10M2D3I7M"))
    assert one(spark, cg.end_position(F.lit(100), c)) == 119
    assert one(spark, cg.aligned_bases(F.lit("ACGTACG"), cg.parse_cigar(F.lit("2S3M1D2I")))) == "GTA-CG"
    clips = one(spark, cg.soft_clips(F.lit(100), cg.parse_cigar(F.lit("2S3M1D2I2S"))))
    assert [(c.size, c.read_pos, c.genome_pos) for c in clips] == [(2, 2, 100), (2, 8, 104)]


def test_scalars(spark):
    assert one(spark, iv.minimum_bin(F.lit(0), F.lit(16384))) == 4681
    assert one(spark, iv.minimum_bin(F.lit(0), F.lit(16385))) == 585
    assert one(spark, sq.reverse_complement(F.lit("ACGTN"))) == "NACGT"
    sq.register(spark)
    assert spark.sql("SELECT reverse_complement('AACG') x").first().x == "CGTT"


def test_flags(spark):
    df = spark.createDataFrame([(f, 0) for f in (0x63, 0x463, 0x104, 0x800)], "flag int, pos int")
    assert sorted(r.flag for r in reads.good_reads(df).collect()) == [0x63, 0x800]


def test_region_scan_and_join_with_long_reads(spark):
    rows = [(0, 90, 100), (0, 90, 101), (0, 199, 250), (0, 200, 260), (0, 10, 70000)]
    df = spark.createDataFrame(rows, "ctg long, pos long, epos long")
    assert sorted(r.epos for r in regions.region_scan(df, 0, 100, 200).collect()) == [101, 250, 70000]
    spans = spark.createDataFrame([(0, 100, 40000), (0, 50000, 90000)], "ctg long, begin long, end long")
    got = sorted((r.begin, r.epos) for r in regions.region_join(spans, df).collect())
    assert got == [(100, 101), (100, 250), (100, 260), (100, 70000), (50000, 70000)]


def test_read_pairs_take_the_last_master(spark):
    schema = "name string, mate int, ctg long, pos long, epos long, rev boolean, lib_id int"
    m = spark.createDataFrame([("a", 1, 0, 5, 9, False, 0), ("a", 1, 1, 2, 6, True, 0)], schema)
    s = spark.createDataFrame([("a", 1, 3, 1, 5, True, 0), ("a", 1, 4, 1, 5, False, 0)], schema)
    got = sorted((r.m_ctg, r.s_ctg, r.m_last, r.concordant) for r in reads.read_pairs(m, s).collect())
    assert got == [(1, 3, 5, True), (1, 4, 5, False)]


def test_frame_coverage_equals_per_base_sum(spark, tiled):
    rnd = random.Random(1)
    rs = [(c, p, p + rnd.randint(1, 30)) for c in (0, 1) for p in [rnd.randint(0, 200) for _ in range(80)]]
    frames = [(0, 4, 9), (0, 50, 120), (1, 0, 400), (1, 33, 33)]
    r = spark.createDataFrame(rs, "ctg long, pos long, epos long")
    f = spark.createDataFrame(frames, "ctg long, begin long, end long")
    got = {(x.ctg, x.begin, x.end): x.reads_len for x in coverage.frame_reads_length(f, r, ["ctg", "begin", "end"]).collect()}
    for c, b, e in frames:
        assert got[(c, b, e)] == sum(max(0, min(q - 1, e) - max(p, b) + 1) for k, p, q in rs if k == c)
    depth = coverage.base_depth(r).collect()
    assert sum((x.end - x.begin) * x.depth for x in depth) == sum(q - p for _, p, q in rs)


def test_insert_statistics(spark):
    schema = "lib_id int, flag int, ctg long, pos long, epos long, mctg long, mpos long, len int"
    df = spark.createDataFrame([(0, 0x63, 0, 0, 50, 0, 50, 50), (0, 0x63, 0, 0, 50, 0, 150, 50)], schema)
    libs = spark.createDataFrame([(0, 90, 500)], "lib_id int, min_isize int, max_isize int")
    row = stats.insert_size_stats(df, libs).first()
    assert (row.n, row.isize_mean) == (2, 150) and abs(row.isize_std - (5000 / 3) ** 0.5) < 1e-9


def test_assembly_stats(spark, tiled):
    row = stats.assembly_stats(spark.createDataFrame([(10,), (20,), (30,), (40,)], "length long")).first()
    assert (row.total, row.n50_len, row.l50_count) == (100, 30, 2)


def test_library_combination(spark):
    cases = [((0.9, 12, -5.0, 3), (0.9, 12)), ((-5.0, 5, -5.0, 5), (-5.0, 0)), ((-1.0, 12, -4.0, 12), (-10.0, 0)), ((0.4, 12, 0.7, 20), (0.7, 20)), ((-1.0, 0, -5.0, 0), (-5.0, 0))]
    for args, want in cases:
        w, n = edges.combine_libraries(*[F.lit(a) for a in args])
        assert (one(spark, w), one(spark, n)) == want


def test_safe_edges_and_region_zscore(spark):
    assert [one(spark, edges.safe_edge(F.lit(w), F.lit(False))) for w in (0.29, 0.30, -5.0)] == [True, False, False]
    lib = spark.createDataFrame([(0, 300.0, 30.0)], "lib_id int, isize_mean double, isize_std double")
    region = spark.createDataFrame([(1, 0, 0, 5000)], "region_id int, ctg long, begin long, end long")
    for n, want in ((9, 1.0), (5, 0.0)):
        aln = spark.createDataFrame(
            [(0, 0x63, 0, i, i + 50, 0, i + 260, 1) for i in range(n)],
            "lib_id int, flag int, ctg long, pos long, epos long, mctg long, mpos long, nh int",
        )
        assert abs(edges.region_zscores(region, aln, lib).first().z - want) < 1e-9


def _diagonals(a, b, k=20):
    from collections import Counter

    at = Counter()
    for i in range(len(a) - k + 1):
        for j in range(min(i, len(b) - k) + 1):
            if a[i : i + k] == b[j : j + k]:
                at[i - j] += 1
    return dict(at)


def test_seed_diagonals_with_frequent_words(spark):
    rnd = random.Random(2)
    plain = "".join(rnd.choice("ACGT") for _ in range(200))
    cases = [(plain, plain[30:150]), ("A" * 150 + plain, plain[:60] + "A" * 140), ("A" * 120, "A" * 110)]
    # repeats of two and three bases, the same word at unlike distances on the two sides, and repeats cut by other bases
    spaced = lambda n, k: (plain[:20] + plain[60 : 60 + n]) * k
    cases += [("AC" * 60, "AC" * 45 + plain[:40]), ("ACG" * 40, "CGA" * 30 + "AC" * 20), (spaced(3, 7), spaced(5, 4)), (spaced(5, 3) + spaced(2, 4), spaced(2, 5))]
    cases += [(("AC" * 20 + "G") * 3, "CA" * 30 + "T" + "AC" * 25), ("", plain), (plain, "AC")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "id int, a string, b string")
    hits = kmers.diagonal_hits(kmers.words(df, "id", F.col("a")), kmers.words(df, "id", F.col("b")), "id").collect()
    for i, (a, b) in enumerate(cases):
        assert {r.diag: r.hits for r in hits if r.id == i} == _diagonals(a, b)


def test_seeds_of_a_long_repeat_of_two_bases(spark):
    """100,000 places of two words on either side: 2.5 billion pairs, in closed form."""
    n, m = 100_000, 90_000
    df = spark.createDataFrame([(1, "AC" * (n // 2), "AC" * (m // 2))], "id int, a string, b string")
    hits = kmers.diagonal_hits(kmers.words(df, "id", F.col("a")), kmers.words(df, "id", F.col("b")), "id")
    wa, wb = n - 19, m - 19
    want = F.least(F.lit(wb), wa - F.col("diag"))
    row = hits.agg(F.count("*").alias("n"), F.count_if(F.col("hits") != want).alias("wrong"), F.count_if(F.col("diag") % 2 == 1).alias("odd")).first()
    assert (row.n, row.wrong, row.odd) == ((wa + 1) // 2, 0, 0)


def test_seeds_of_stretches(spark, monkeypatch):
    """One row per stretch and not per word; one stretch against several, several against several, many letters."""
    rnd = random.Random(7)
    plain = "".join(rnd.choice("ACGT") for _ in range(400))
    many = "".join(rnd.choice("ACGTNRYKMSWBDHVacgt") for _ in range(150))
    cases = [(plain, plain[70:120]), (plain[200:260], plain), (plain, plain[30:330]), (many, many[20:90]), ("AC" * 150, "AC" * 20), (plain[:64], plain[:83])]
    df = spark.createDataFrame([(None if i == 3 else i, a, b) for i, (a, b) in enumerate(cases)] + [(9, plain, None)], "id int, a string, b string")
    assert kmers.words(df.where("id = 0"), "id", F.col("a")).count() == 1
    monkeypatch.setattr(kmers, "TILE", 64)
    monkeypatch.setattr(banded, "CONVOLVED", 50)
    hits = kmers.diagonal_hits(kmers.words(df, "id", F.col("a")), kmers.words(df, "id", F.col("b")), "id").collect()
    for i, (a, b) in enumerate(cases):
        assert {r.diag: r.hits for r in hits if r.id == (None if i == 3 else i)} == _diagonals(a, b)
    assert not [r for r in hits if r.id == 9]


def test_bam_round_trip_index_and_tags(spark, tmp_path):
    bam.register(spark)
    path = str(tmp_path / "out")
    rows = [(f"r{i}", 0x63, i % 3, i * 700, "5S10M2D3M", -1, -1, "ACGTNACGTACGTACGTA", "I" * 18) for i in range(300)]
    tag = "map('NH', named_struct('type','C','i',1L,'f',CAST(NULL AS DOUBLE),'s',CAST(NULL AS STRING),'arr',CAST(NULL AS ARRAY<DOUBLE>)), 'ZZ', named_struct('type','Z','i',CAST(NULL AS BIGINT),'f',CAST(NULL AS DOUBLE),'s','hello','arr',CAST(NULL AS ARRAY<DOUBLE>)))"
    df = spark.createDataFrame(rows, "name string, flag int, ref_id int, pos int, cigar string, mate_ref_id int, mate_pos int, seq string, qual string")
    df = df.withColumn("tags", F.expr(tag)).coalesce(1).sortWithinPartitions("ref_id", "pos")
    df.write.format("bam").mode("append").option("header", "@HD\tVN:1.0\n").option("references", "a:300000,b:300000,c:300000").save(path)
    back = spark.read.format("bam").load(path)
    got = {r.name: (r.ref_id, r.pos, r.epos, r.cigar, r.seq, r.qual, r.nh, r.tags["ZZ"].s) for r in back.collect()}
    assert got == {r[0]: (r[2], r[3], r[3] + 15, r[4], r[7], r[8], 1, "hello") for r in rows}
    assert bam_index.unsorted_records(back.select("path", "rec_no", "ref_id", "pos")).count() == 0
    file = back.first().path
    text, refs, _ = bam.read_header(file)
    assert text.startswith("@HD") and refs == [("a", 300000), ("b", 300000), ("c", 300000)]
    sizes = spark.createDataFrame([(file, 4)], "path string, n int")  # the last reference has no records
    assert [tuple(r) for r in bam_index.index_files(back, sizes).collect()] == [(file, 39)]
    offsets = bam.index_offsets(file)
    assert [len(o) for o in offsets] == [13, 13, 13, 0] and all(v for o in offsets for v in o)
    split = spark.read.format("bam").option("splitBytes", "1").load(path)
    assert split.count() == 300 and split.select("name").distinct().count() == 300
    assert {r.ref_id for r in spark.read.format("bam").option("ref", "1").load(path).collect()} == {1}
    region = spark.read.format("bam").option("ref", 2).option("begin", 70_000).option("end", 140_000).load(path)
    assert sorted(r.pos for r in region.collect()) == [r[3] for r in rows if r[2] == 2 and r[3] < 140_000 and r[3] + 15 > 70_000]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert spark.read.format("bam").option("pushdown", "true").load(path).where("ref_id = 2").count() == 100


def test_bam_region_without_index(spark, tmp_path):
    bam.register(spark)
    rows = [(f"r{i}", 0, i % 3, i * 10, "10M", -1, -1) for i in range(60)] + [("u", 4, -1, -1, "", -1, -1)]
    df = spark.createDataFrame(rows, "name string, flag int, ref_id int, pos int, cigar string, mate_ref_id int, mate_pos int")
    df.coalesce(1).write.format("bam").mode("append").option("references", "a:1000,b:1000,c:1000").save(str(tmp_path / "x"))
    load = lambda **o: {r.name for r in spark.read.format("bam").options(**o).load(str(tmp_path / "x")).collect()}
    assert load(ref=2) == {r[0] for r in rows if r[2] == 2}
    assert load(ref=1, begin=105, end=311) == {r[0] for r in rows if r[2] == 1 and r[3] < 311 and r[3] + 10 > 105}
    assert load(ref=7) == set()
    with pytest.raises(Exception, match="needs the option ref"):
        load(begin=5)


def test_bam_writes_do_not_meet(spark, tmp_path):
    bam.register(spark)
    path = str(tmp_path / "w")

    def write(lo, hi, mode):
        df = spark.range(lo, hi, 1, 3).selectExpr("concat('r', id) AS name", "0 AS flag", "0 AS ref_id", "CAST(id AS INT) AS pos", "'5M' AS cigar", "-1 AS mate_ref_id", "-1 AS mate_pos")
        df.write.format("bam").mode(mode).option("references", "a:100000").save(path)

    names = lambda: sorted(r.pos for r in spark.read.format("bam").load(path).collect())
    write(0, 100, "append")
    write(100, 200, "append")
    assert names() == list(range(200))
    write(500, 510, "overwrite")
    assert names() == list(range(500, 510))
    with pytest.raises(Exception):  # a failing write leaves what was there, and nothing of its own
        bad = spark.range(0, 50, 1, 2).selectExpr("if(id = 49, CAST(NULL AS STRING), 'x') AS name", "0 AS flag", "0 AS ref_id", "0 AS pos", "'5M' AS cigar", "-1 AS mate_ref_id", "-1 AS mate_pos")
        bad.write.format("bam").mode("overwrite").option("references", "a:100000").save(path)
    assert names() == list(range(500, 510))
    assert not [p for p in os.listdir(path) if not p.endswith(".bam")]


def test_six_significant_digits(spark):
    values = [0.0, 1.0, 333.333333333, 29.1356, 123456.7, 1234567.0, 0.000123456789, 0.0000123456, -2.5e-9, 1e12, 999999.6]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(sink._six_digits(F.col("v")).alias("s"))
    assert [r.s for r in df.collect()] == ["%g" % v for v in values]


def test_text_inputs(spark, tmp_path):
    (tmp_path / "libs").write_text("  /a.bam \n90 270\n/b.bam\n\n")
    libs = textfiles.read_library_list(spark, str(tmp_path / "libs"))
    assert sorted((r.lib_id, r.path, r.min_isize, r.max_isize) for r in libs.collect()) == [(0, "/a.bam", 90, 270), (1, "/b.bam", 0, 0)]
    (tmp_path / "st").write_text("/a.bam\n300.5\t20.25\t9\n/x.bam\n1\t2\t3\n")
    assert [(r.path, r.isize_mean) for r in textfiles.read_library_stats(spark, str(tmp_path / "st"), libs).collect()] == [("/a.bam", 300.5)]
    (tmp_path / "fa").write_text(">one first\nACGT\nacgx\n>two\nAC-T\n")
    assert {r.name: r.sequence for r in textfiles.read_fasta(spark, str(tmp_path / "fa")).collect()} == {"one": "ACGTACGN", "two": "ACNT"}
    assert {r.name: r.length for r in textfiles.fasta_lengths(spark, str(tmp_path / "fa")).collect()} == {"one": 8, "two": -1}
    contigs = spark.createDataFrame([(0, "one", 8)], "ctg_id long, name string, length long")
    with pytest.raises(Exception, match="sequence without a contig"):
        textfiles.attach_sequences(contigs, textfiles.read_fasta(spark, str(tmp_path / "fa"))).collect()


def test_fasta_and_stats_outputs(spark, tmp_path):
    seqs = spark.createDataFrame([(0, "a", "ACGT" * 40), (1, "b", "G" * 60)], "ctg_id long, name string, sequence string")
    sink.write_contigs(seqs, str(tmp_path / "fa"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "fa").glob("part-*")))
    assert text == ">a\n" + "ACGT" * 15 + "\n" + "ACGT" * 15 + "\n" + "ACGT" * 10 + "\n>b\n" + "G" * 60 + "\n"
    census = spark.createDataFrame([("forks", 2)], "graph_class string, graphs long")
    assert [r.value for r in sink.stats_lines(census).orderBy("ord").collect()] == ["Linears = 0", "Forks = 2", "Bubbles = 0", "Cyclics = 0"]
    row = spark.createDataFrame([(0, "p", 333.333333333, 29.1356, 8.0)], "lib_id int, path string, isize_mean double, isize_std double, coverage double")
    assert sink.library_stats_lines(row, six_digits=True).first().value == "p\n333.333\t29.1356\t8"


def test_graph_files(spark, tmp_path):
    census = spark.createDataFrame([("forks", 2)], "graph_class string, graphs long")
    sink.write_stats(census, str(tmp_path / "st"))
    read = lambda p: "".join(f.read_text() for f in sorted((tmp_path / p).glob("part-*")))
    assert read("st") == "[graphs stats]\nLinears = 0\nForks = 2\nBubbles = 0\nCyclics = 0\n"
    comps = spark.createDataFrame([("m", 0, 0), ("s", 1, 0), ("m", 4, 4), ("s", 2, 4)], "asm string, ctg long, component long")
    pairs = spark.createDataFrame([(0, 1), (4, 2)], "m_ctg long, s_ctg long")
    sink.write_dot(sink.contig_dot(comps, pairs), "component", str(tmp_path / "dot"))
    one = 'graph ContigGraph_{0} {{\n\tm{0}[label="{0}"];\n\ts{1}[label="{1}"];\n\tm{0}--s{1}[color=black];\n}}\n'
    assert read("dot") == one.format(0, 1) + one.format(4, 2)


def test_header_issues(spark):
    text = ["@HD\tVN:1.x", "@SQ\tSN:=chr\tLN:10", "@SQ\tSN:a\tLN:0", "@SQ\tSN:a\tLN:5", "@PG\tID:p\tPP:q", "@RG\tID:g\tPL:Illumina"]
    df = spark.createDataFrame(list(enumerate(text)), "line_no long, line string")
    got = sorted((r.line_no, r.issue) for r in sam_header.validate(sam_header.parse(df)).collect())
    assert got == [(0, "version"), (1, "sequence name"), (2, "sequence length"), (3, "repeated sequence name"), (4, "unknown previous program")]

import math

from contigloom.llm import lengths
from contigloom.llm.queries import RANKS


def test_encoded_lengths(spark, odd_docs):
    import base64

    import tiktoken

    ranks = lengths.read_ranks(RANKS)
    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    encoding = tiktoken.Encoding("t", pat_str=lengths.PATTERN, mergeable_ranks=known, special_tokens={})
    docs = odd_docs.where("text IS NULL OR length(text) < 5000")
    want = sorted((str(r.doc_id), len(encoding.encode_ordinary(r.text or ""))) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in lengths.token_counts(docs, ranks).collect()) == want
    assert all(encoding.decode(encoding.encode_ordinary(r.text)) == r.text for r in docs.where("text IS NOT NULL").collect())
    assert lengths.token_counts(odd_docs, ranks).count() == odd_docs.count()


def test_sums_quantiles_and_limits(spark, monkeypatch):
    monkeypatch.setattr(lengths, "TILE", 4)  # several tiles and groups of tiles
    sizes = [0, 0, 0, 1, 3, 3, 5, 8, 16, 16, 17, 63, 64, 65, 200, 1000]
    hist = lengths.histogram(spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n_tokens long"))
    sums = lengths.running(hist)
    for r in sums.collect():
        upto = [s for s in sizes if s <= r.n_tokens]
        assert r.n_docs == sizes.count(r.n_tokens) and r.docs_up_to == len(upto) and r.tokens_up_to == sum(upto)
        assert r.docs_over == len(sizes) - len(upto) and r.tokens_over == sum(sizes) - sum(upto)
        assert r.truncated_tokens == sum(min(s, r.n_tokens) for s in sizes) and r.rank == len(upto) / len(sizes)
    assert tuple(lengths.totals(hist).first()) == (len(sizes), sum(sizes))
    for r in lengths.truncated(sums, [0, 1, 4, 16, 500, 10**6]).collect():
        assert r.tokens == sum(min(s, r.context) for s in sizes) and r.cut_docs == sum(s > r.context for s in sizes)
    for r in lengths.quantiles(sums, [0.1, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == sorted(sizes)[math.ceil(r.share * len(sizes)) - 1]


def test_empty(no_docs):
    hist = lengths.histogram(lengths.token_counts(no_docs, lengths.read_ranks(RANKS)))
    sums = lengths.running(hist)
    assert sums.collect() == [] and tuple(lengths.totals(hist).first()) == (0, 0)
    assert [tuple(r) for r in lengths.quantiles(sums, [0.5]).collect()] == [(0.5, None)]
    assert [tuple(r) for r in lengths.truncated(sums, [8]).collect()] == [(8, 0, 0)]

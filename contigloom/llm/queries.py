"""The registered queries of the text operators, each over its whole table, and their oracle SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contigloom.llm import chat, decontaminate, divergence, lengths, licenses, mixing, near_dedup, negatives, pii, ppm, quality, sharding, topk
from contigloom.llm.shared import crc_part, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NEAR_SQL = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
    FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
    SELECT c.a, c.b FROM common c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b
    WHERE 100 * c.k >= 80 * (x.n + y.n - c.k)
), reach AS (
    SELECT a AS doc_id, a AS r FROM link UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r
), low AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(low.r, d.doc_id)::BIGINT AS component_id,
       coalesce(low.r, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""


@query("op4_near_dedup", _NEAR_SQL)
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4, similarity=80)


@query("op1_ppm")
def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.ppm_scores(table(spark, sf_dir, "documents"), crc_part(F.col("doc_id"), 7) == 2)


def _license_sql() -> str:
    """Diagonal voting in DuckDB; a document's id stands for its row."""
    rows = [(text, label, True) for text, label in licenses.PHRASES.items()] + [(text, label, False) for text, label in licenses.NOTICES.items()]
    values = ", ".join(f"({i}, $${t}$$, '{label}', {phrase})" for i, (t, label, phrase) in enumerate(rows))
    words = "list_filter(regexp_split_to_array({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""
WITH d AS (SELECT doc_id, {words.format(_LOWER)} AS ws FROM documents
), t AS (
    SELECT *, len(ws) AS size FROM (SELECT template, label, phrase, CASE WHEN phrase THEN 2 ELSE 4 END AS k, {words.format("lower(text)")} AS ws
    FROM (VALUES {values}) v(template, text, label, phrase)) x WHERE len(ws) >= k
), tg AS (
    SELECT template, k, place, array_to_string(ws[place + 1:place + k], ' ') AS gram FROM (SELECT *, unnest(range(0, size - k + 1)) AS place FROM t) x
), dg AS (
    SELECT doc_id, k, spot, array_to_string(ws[spot + 1:spot + k], ' ') AS gram
    FROM (SELECT doc_id, ws, k, unnest(range(0, greatest(len(ws) - k + 1, 0))) AS spot FROM d CROSS JOIN (VALUES (2), (4)) v(k)) x
), votes AS (
    SELECT doc_id, t.*, spot, place, spot - place AS diagonal FROM dg JOIN tg USING (k, gram) JOIN t ON t.template = tg.template
), opened AS (
    SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= {licenses.GAP} THEN 0 ELSE 1 END AS opens
    FROM votes WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal, spot)
), units AS (
    SELECT *, CASE WHEN phrase THEN diagonal ELSE sum(opens) OVER (PARTITION BY doc_id, template ORDER BY diagonal, spot) END AS unit FROM opened
), covered AS (
    SELECT doc_id, template, label, phrase, size, k, unit, count(DISTINCT word) AS words, min(spot) AS lo, max(spot) + k AS stop
    FROM (SELECT *, unnest(range(place, place + k)) AS word FROM units) x GROUP BY doc_id, template, label, phrase, size, k, unit
), found AS (
    SELECT *, words / size AS cover FROM covered
    WHERE CASE WHEN phrase THEN words = size ELSE words >= 0.75 * size AND stop - lo <= 2 * size END
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, count(label) FILTER (phrase)::BIGINT AS n_base,
       min(lo) FILTER (phrase)::BIGINT AS first_word, max(lo) FILTER (phrase)::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(cover), 0)::DOUBLE AS score
FROM d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id, len(ws)
"""


@query("op2_license_scan", _license_sql())
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TOP_K_SQL = """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.v, v.v)::BIGINT AS score
    FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


@query("op3_top_k", _TOP_K_SQL)
def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(topk.whole_vectors(table(spark, sf_dir, "embeddings")), "whole")  # read as vectors and as queries
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


#: Target weights of the mix, by level; nodes that are not named have weight 1.
MIX_WEIGHTS = {
    "domain": {"domain0": 30, "domain1": 30, "domain2": 25, "domain3": 15},
    "lang": {"en": 60, "de": 15, "fr": 15, "es": 10},
}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.8, 4, 7


def _mix_sql() -> str:
    """The mix in DuckDB: the tree level by level, then running sums over each leaf's order."""

    def weight(level):
        cases = " ".join(f"WHEN '{n}' THEN {w}" for n, w in MIX_WEIGHTS.get(level, {}).items())
        return f"CASE mix_{level} {cases} ELSE 1 END" if cases else "1"

    def filled(level, above):
        keys = ", ".join([*above, f"mix_{level}"])
        parent = f"PARTITION BY {', '.join(above)}" if above else ""
        budget = f"given_{above[-1]}" if above else "(SELECT floor(sum(tokens) * {share})::HUGEINT FROM leaves)".format(share=MIX_SHARE)
        join = f"JOIN {budget} g USING ({', '.join(above)})" if above else ""
        amount = "g.budget" if above else budget
        order = f"{parent} ORDER BY capacity::DOUBLE / weight, mix_{level}"
        return f"""
n_{level} AS (
    SELECT *, budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS here,
           sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
    FROM (SELECT {keys}, {amount} AS budget, sum(tokens)::HUGEINT * {MIX_EPOCHS} AS capacity, any_value({weight(level)})::HUGEINT AS weight
          FROM leaves {join} GROUP BY {keys}{", g.budget" if above else ""})
), s_{level} AS (
    SELECT *, first_value(CASE WHEN capacity * weights > here * weight THEN here END IGNORE NULLS) OVER w AS h,
           first_value(CASE WHEN capacity * weights > here * weight THEN weights END IGNORE NULLS) OVER w AS ws
    FROM n_{level} WINDOW w AS ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), given_mix_{level} AS (
    SELECT {keys}, CASE WHEN h IS NULL THEN capacity ELSE least(h * weight // ws, capacity) END AS budget FROM s_{level}
)"""

    levels, above = [], []
    for level in ("domain", "lang", "source"):
        levels.append(filled(level, above))
        above = [*above, f"mix_{level}"]
    return rf"""
WITH rows AS (
    SELECT doc_id, text, coalesce(lang, 'unknown') AS mix_lang, coalesce(source, 'unknown') AS mix_source,
           CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'other'
                ELSE 'domain' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::BIGINT % 4) END AS mix_domain,
           len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS mix_tokens
    FROM documents WHERE len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) > 0
), leaves AS (
    SELECT mix_domain, mix_lang, mix_source, sum(mix_tokens)::HUGEINT AS tokens FROM rows GROUP BY ALL
), {", ".join(levels)},
placed AS (
    SELECT r.*, g.budget // l.tokens AS epochs, g.budget % l.tokens AS rest,
           md5('{MIX_SEED}|' || (g.budget // l.tokens) || '|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(text)) AS place
    FROM rows r JOIN leaves l USING (mix_domain, mix_lang, mix_source) JOIN given_mix_source g USING (mix_domain, mix_lang, mix_source) WHERE g.budget > 0
), cut AS (
    SELECT *, coalesce(sum(mix_tokens) OVER (PARTITION BY mix_domain, mix_lang, mix_source ORDER BY substr(place, 1, 15), coalesce(doc_id::VARCHAR, ''), md5(text)
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM placed
)
SELECT doc_id, mix_domain, mix_lang, mix_source, mix_tokens::BIGINT AS mix_tokens, epochs::BIGINT AS mix_epochs,
       least(mix_tokens, greatest(rest - ahead, 0))::BIGINT AS mix_extra
FROM cut WHERE epochs > 0 OR least(mix_tokens, greatest(rest - ahead, 0)) > 0
"""


@query("op5_mixing", _mix_sql())
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return mixed.select("doc_id", "mix_domain", "mix_lang", "mix_source", "mix_tokens", "mix_epochs", "mix_extra")


#: Where the public vocabularies lie; a parameter of the installation.
RANKS = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@query("op7_lengths")
def op7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = lengths.token_counts(table(spark, sf_dir, "documents"), lengths.read_ranks(RANKS))
    return lengths.running(stored(lengths.histogram(counts), "lengths"))  # the sums read it three times


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), crc_part(F.col("doc_id"), 5) != 0)
    return quality.scores(docs, model, ["doc_id"]).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (crc_part(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.3).cast("int").alias("predicted"),
    )


_CHAT_SQL = f"""
WITH t AS (
    SELECT conv_id, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END AS speaker, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END, coalesce(text, '')) - 1 AS nth
    FROM conversations
), views AS (
    SELECT t.*, nth // {chat.CHUNK} AS chunk, p.perspective, t.speaker = p.perspective AS own,
           '<|im_start|>' || CASE WHEN t.speaker = p.perspective THEN 'assistant' WHEN t.speaker = 'system' THEN 'system' ELSE 'user name=' || t.speaker END || chr(10) AS head,
           text || '<|im_end|>' || chr(10) AS body
    FROM t JOIN (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system') p ON p.conv_id IS NOT DISTINCT FROM t.conv_id
), placed AS (
    SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY nth) AS stop FROM views
)
SELECT conv_id, perspective, chunk::BIGINT AS chunk, count(*)::BIGINT AS n_turns, count(*) FILTER (own)::BIGINT AS n_own,
       min(stop - length(head) - length(body))::BIGINT AS first_char, string_agg(head || body, '' ORDER BY nth) AS text,
       coalesce(string_agg((stop - length(body))::VARCHAR || ':' || stop::VARCHAR, ',' ORDER BY nth) FILTER (own), '') AS mask
FROM placed GROUP BY conv_id, perspective, chunk
"""


@query("op10_perspectives", _CHAT_SQL)
def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return rendered.withColumn("mask", F.array_join(spans, ","))


@query("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.report(docs, pii.fit(docs))


_NEGATIVES_SQL = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
    FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 50 = 0
), p AS (
    SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS nth
    FROM s WHERE same QUALIFY nth <= 5
), n AS (
    SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.nth ORDER BY s.score DESC, s.vec_id) AS rank
    FROM p JOIN s ON s.r = p.r AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@query("op11_hard_negatives", _NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.col("label").cast("long")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.hard_negatives(negatives.whole_vectors(rows), F.col("vec_id") % 50 == 0)


_SHARD_SQL = f"""
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
    FROM range(256) r(i)
), digits AS (
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes,
           list_transform(string_split(hex(encode(coalesce(text, ''))), ''), lambda h: instr('0123456789ABCDEF', h) - 1) AS h FROM documents
), sized AS (
    SELECT doc_id, (bytes + 8)::BIGINT AS size, CASE WHEN bytes = 0 THEN 0 ELSE xor(4294967295::BIGINT,
           list_reduce([4294967295::BIGINT] || list_transform(range(1, bytes + 1), lambda k: h[2 * k - 1] * 16 + h[2 * k]),
                       lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) END AS text_crc32
    FROM digits, crc_table
), jumps AS (
    SELECT DISTINCT doc_id, 0::DOUBLE AS spot, ((coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616)::HUGEINT AS state FROM documents
    UNION ALL
    SELECT doc_id, floor((spot + 1) * (2147483648::DOUBLE / (next // 8589934592 + 1)::DOUBLE)), next
    FROM (SELECT doc_id, spot, (state * {sharding.MULTIPLIER} + 1) % 18446744073709551616 AS next FROM jumps WHERE spot < 25) j
), placed AS (
    SELECT doc_id, (max(spot) FILTER (spot < 24))::INTEGER AS shard, (max(spot) FILTER (spot < 25))::INTEGER AS grown_shard FROM jumps GROUP BY doc_id
)
SELECT s.doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY s.doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot, grown_shard
FROM sized s JOIN placed p ON p.doc_id IS NOT DISTINCT FROM s.doc_id
"""

SHARDS = 24


@query("op12_sharding", _SHARD_SQL)
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"), SHARDS)


_DIVERGENCE_SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), w AS (SELECT doc, lang, source, unnest(ws) AS term FROM d
), c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs FROM w GROUP BY ALL
), v AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= {divergence.LEAST_DOCS}
), l AS (SELECT lang, count(*) AS kept, sum(n)::BIGINT AS total FROM v GROUP BY lang
), g AS (
    SELECT d.lang, d.source, coalesce(any_value(l.kept), 0) AS kept, coalesce(any_value(l.total), 0) AS lang_total, coalesce(any_value(t.total), 0) AS total
    FROM d LEFT JOIN l USING (lang) LEFT JOIN (SELECT lang, source, sum(c.n)::BIGINT AS total FROM c JOIN v USING (lang, term) GROUP BY ALL) t USING (lang, source)
    GROUP BY d.lang, d.source
), p AS (
    SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * g.kept) AS p,
           1 + 1000000000::HUGEINT * (v.n + 2) // (g.lang_total + 2 * g.kept) AS q
    FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), pair AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), every AS (
    SELECT * FROM pair UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM every QUALIFY part = 'pair' OR rank <= {divergence.TOP}
"""


@query("op13_divergence", _DIVERGENCE_SQL)
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

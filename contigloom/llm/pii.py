"""Personal data by candidates and gradient boosting, in DataFrame operations only.

High-recall patterns propose spans, which may overlap across kinds.  Boosted
trees judge each from its format and the characters around it, and a threshold
per kind, calibrated on candidates that were not learnt from, selects.  The
spans of the base kinds that pass their exact check (address parts, checksum,
number of digits) are always selected; of the other kinds the trees select.

Labels are weak: whether a candidate passes the check of its kind, which the
trees do not see (address parts, Luhn and mod-97 sums, digits and letters
mixed).  Trees and thresholds come from all distinct candidates (by text and
features, so copies of a document count once), every other one for thresholds.
Candidates that look the same are one row with their number, and the numbers of
a kind weigh together as much as ``SAMPLE`` candidates at most, so that a common
kind leaves room for rare ones.
Fitted trees become one expression, so all texts are scored where they are
read: no shuffle, no row identity.

Patterns have no place to start inside a run and no way back (possessive, and
anchored at a run's start or at the last match), which changes no match but
keeps long texts linear.  Offsets are code points, end exclusive.

Null and empty texts have no spans.  Repeated rows give repeated results, null
ids stay null, other columns are ignored (``redact`` passes them through).
Without candidates to learn from, only the base spans are selected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 8000
TREES, DEPTH = 8, 3
#: Values of a feature between which trees can cut; up to its square of rows Spark ML looks at all of them.
BINS = 1024
PRECISION = 0.95
AROUND = 24

# The base patterns, and what proposes the other kinds.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "local": r"(?<![0-9+(.-])\(?+[0-9]{3}\)?+[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
}
BASE = ("email", "ip", "card", "phone")
#: A character without which a kind has no match: texts that lack it are not searched.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
HINTS = r"(?i)(?:token|secret|passw|key|api|auth|tel|phone|call|mobil|fax|iban|konto|account|card|mail)[^a-z]{0,6}$"
FEATURES = (
    "length", "digits", "letters", "upper", "hex", "separators", "groups", "distinct", "longest_digits",
    "hint", "quoted", "equals", "word_before", "word_after", "kind",
)


def _part(pattern: str, text: Column) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + doubled

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _mod97(match: Column) -> Column:
    """Checksum of an account number: letters count from 10, the first four characters go last."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))

    def add(rest, i):
        c = F.substring(turned, i, F.lit(1))
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + letter) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _passes(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return {
        "email": F.lit(True),
        "ip": match.rlike(rf"^{octet}(?:\.{octet}){{3}}$"),
        "card": F.when(n.between(13, 19), _luhn(_digits(match))).otherwise(F.lit(False)),
        "phone": n.between(9, 15),
        "iban": _mod97(match),
        "local": ~match.rlike(r"^\(?[01]"),
        "secret": match.rlike("[0-9].*[0-9]") & match.rlike("[A-Za-z]") & ~match.rlike("-.*-.*-.*-.*-"),
    }[kind]


def _candidates(kind: str, text: Column) -> tuple[Column, Column]:
    """(matches, pieces between them); the pieces are only taken where there is a match."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    if kind in NEEDS:
        found = F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast("array<string>"))
    return found


def _placed(kind: str, text: Column, found: Column) -> Column:
    """array<struct<kind, start, end, match>>: running lengths of pieces and matches give the places."""
    pairs = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("piece"), found.alias("match"))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,match:string>>")

    def add(state, p):
        start = state["at"] + F.length(p["piece"])
        end = start + F.coalesce(F.length(p["match"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), p["match"].alias("match"))
        spans = F.when(p["match"].isNull(), state["spans"]).otherwise(F.concat(state["spans"], F.array(span)))
        return F.struct(end.alias("at"), spans.alias("spans"))

    placed = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("spans")), add)["spans"]
    return F.when(F.size(found) > 0, placed).otherwise(empty)


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii_text`` and, for each kind, ``pii_<kind>``: the candidates with their places."""
    rows = docs.withColumn("pii_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = rows.withColumns({f"pii_m_{k}": _candidates(k, F.col("pii_text")) for k in PATTERNS})
    rows = rows.withColumns({f"pii_{k}": _placed(k, F.col("pii_text"), F.col(f"pii_m_{k}")) for k in PATTERNS})
    return rows.drop(*[f"pii_m_{k}" for k in PATTERNS])


def _features(kind: Column, text: Column, span: Column) -> list[Column]:
    match, start, end = span["match"], span["start"], span["end"]
    left = F.substring(text, F.greatest(start - AROUND, F.lit(0)) + 1, F.least(start, F.lit(AROUND)))
    before, after = F.substring(left, F.lit(-1), F.lit(1)), F.substring(text, end + 1, F.lit(1))
    runs = F.split(match, "[^0-9]+")
    number = reduce(lambda c, i: c.when(kind == list(PATTERNS)[i], F.lit(float(i))), range(1, len(PATTERNS)), F.when(kind == "email", F.lit(0.0)))
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        F.length(match),
        _part("[^0-9]", match),
        _part("[^A-Za-z]", match),
        _part("[^A-Z]", match),
        _part("[^0-9a-f]", match),
        _part(r"[A-Za-z0-9]", match),
        F.size(F.split(match, "[^A-Za-z0-9]+")),
        F.size(F.array_distinct(F.split(match, ""))),
        F.array_max(F.transform(runs, lambda r: F.length(r))),
        yes(left.rlike(HINTS)),
        yes(before.isin("'", '"', "<", "(")),
        yes(left.rlike(r"[=:]\s*[\"']?$")),
        yes(before.rlike("[A-Za-z0-9]")),
        yes(after.rlike("[A-Za-z0-9]")),
        number,
    ]


class Judge:
    """Fitted trees as nested (feature, threshold, left, right) or leaf values, and a threshold per kind."""

    def __init__(self, trees: list[tuple[float, object]], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def probability(self, features: list[Column]) -> Column:
        def value(node):
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, at, left, right = node
            return F.when(features[feature].cast("double") <= at, value(left)).otherwise(value(right))

        margin = reduce(lambda a, b: a + b, (weight * value(tree) for weight, tree in self.trees))
        return 1 / (1 + F.exp(-2 * margin))


def _node(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    split = node.split()
    return split.featureIndex(), split.threshold(), _node(node.leftChild()), _node(node.rightChild())


def _candidate_rows(docs: DataFrame) -> DataFrame:
    """(pii_text, span) of every candidate of every text."""
    rows = candidates(docs.select("text"))
    return rows.select("pii_text", F.explode(F.concat(*[F.col(f"pii_{k}") for k in PATTERNS])).alias("span"))


def _facts(every: DataFrame) -> DataFrame:
    """(kind, match, label, f_...) of candidates; a match has one row for each of its contexts."""
    kind, match = F.col("span.kind"), F.col("span.match")
    label = reduce(lambda c, k: c.when(kind == k, _passes(k, match)), list(PATTERNS)[1:], F.when(kind == "email", F.lit(True)))
    features = [f.cast("double").alias(f"f_{n}") for f, n in zip(_features(kind, F.col("pii_text"), F.col("span")), FEATURES)]
    return every.select(kind.alias("kind"), match.alias("match"), F.when(label, 1.0).otherwise(0.0).alias("label"), *features).distinct()


def _sample(docs: DataFrame) -> DataFrame:
    """(kind, place, label, f_...) of at most SAMPLE distinct candidates of each kind, to look at; places count from 1 in each kind."""
    every = _candidate_rows(docs)
    # twice as many matches as needed are let through, for their number is known to a few hundredths only
    sizes = every.groupBy("span.kind").agg(F.approx_count_distinct("span.match").alias("n")).collect()  # a row per kind
    least = {r.kind: int((2 * SAMPLE / r.n - 0.5) * 2**64) for r in sizes if r.n > 2 * SAMPLE}
    kind, match = F.col("span.kind"), F.col("span.match")
    below = reduce(lambda c, k: c.when(kind == k, F.xxhash64(kind, match) < least[k]), least, F.when(F.lit(False), False)).otherwise(True)
    # a match has a bounded number of contexts (five features of yes or no), so the window reads a bounded number
    names = [f"f_{n}" for n in FEATURES]
    order = Window.partitionBy("kind").orderBy(F.xxhash64("kind", "match", *names), "match", *names)
    return _facts(every.where(below)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE).drop("match")


def _counted(docs: DataFrame) -> DataFrame:
    """(kind, learn, label, f_..., n): how many distinct candidates of all texts look like this.

    Every other match, by hash, is learnt from; the rest set the thresholds.
    """
    facts = _facts(_candidate_rows(docs)).withColumn("learn", F.pmod(F.xxhash64("match", F.lit("half")), F.lit(2)) == 1)
    return facts.groupBy("kind", "learn", "label", *[f"f_{n}" for n in FEATURES]).agg(F.count("*").alias("n"))


def fit(docs: DataFrame) -> Judge:
    """Trees and thresholds from all distinct candidates of ``docs``."""
    counted = _counted(docs).cache()
    sizes = counted.where("learn").groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()  # two rows per kind at most
    if len({r.label for r in sizes}) < 2:
        counted.unpersist()
        return Judge([], {})
    of_kind = {k: sum(r.n for r in sizes if r.kind == k) for k in {r.kind for r in sizes}}
    share = reduce(lambda c, k: c.when(F.col("kind") == k, F.lit(min(1.0, SAMPLE / 2 / of_kind[k]))), of_kind, F.when(F.lit(False), 1.0))
    learn = VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, seed=1, labelCol="label", weightCol="weight")
    model = trees.fit(learn.transform(counted.where("learn").withColumn("weight", F.col("n") * share)))
    java = model._java_obj
    trees = [(w, _node(t.rootNode())) for w, t in zip(model.treeWeights, java.trees())]
    judge = Judge(trees, {})
    judged = counted.where("not learn").select("kind", "label", "n", F.floor(judge.probability([F.col(f"f_{n}") for n in FEATURES]) * 50).alias("bin"))
    bins = judged.groupBy("kind", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("good")).collect()  # at most 51 per kind
    counted.unpersist()
    for kind in PATTERNS:
        n = good = 0
        judge.thresholds[kind] = 0.9
        for r in sorted((r for r in bins if r.kind == kind), key=lambda r: -r.bin):
            n, good = n + r.n, good + r.good
            if good >= PRECISION * n:
                judge.thresholds[kind] = r.bin / 50
    return judge


def spans(docs: DataFrame, judge: Judge) -> DataFrame:
    """``docs`` with ``pii_base`` and ``pii_spans``: array<struct<kind, start, end>>, by kind as listed and start."""
    rows = candidates(docs)

    def slim(array):
        return F.transform(array, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def passing(kind):
        return F.filter(f"pii_{kind}", lambda s: _passes(kind, s["match"]))

    def chosen(kind):
        if not judge.trees:
            return F.array().cast("array<struct<kind:string,start:int,end:int,match:string>>")
        least = judge.thresholds.get(kind, 0.9)
        return F.filter(f"pii_{kind}", lambda s: judge.probability(_features(F.lit(kind), F.col("pii_text"), s)) >= least)

    base = {f"pii_{k}": passing(k) for k in BASE}
    other = {f"pii_{k}": chosen(k) for k in PATTERNS if k not in BASE}
    rows = rows.withColumns(base | other)
    rows = rows.withColumn("pii_base", slim(F.concat(*[F.col(c) for c in base])))
    # what lies in a base span is found already
    apart = F.filter(slim(F.concat(*[F.col(c) for c in other])), lambda s: ~F.exists("pii_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rows = rows.withColumn("pii_spans", F.concat("pii_base", apart))
    return rows.drop("pii_text", *base, *other)


def _listed(array: str) -> Column:
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, judge: Judge) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    found = spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), judge)
    count = lambda k: F.size(F.filter("pii_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_listed("pii_base"), 256).alias("base_sha256"), _listed("pii_spans").alias("spans"))


def redact(docs: DataFrame, judge: Judge) -> DataFrame:
    """``docs`` with each selected span of ``text`` replaced by its kind in brackets.

    Of overlapping spans the first stays, and of those that start together the longest.
    """
    found = spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), judge)
    order = F.transform("pii_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def add(state, s):
        end = -s["end"]
        out = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] >= state["at"], F.struct(end.alias("at"), out.alias("out"))).otherwise(state)

    state = F.aggregate(F.array_sort(order), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add)
    clean = F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))
    new = F.when(F.size("pii_spans") > 0, clean).otherwise(F.col("text"))
    return found.select(*[new.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])

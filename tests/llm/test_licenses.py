import re

from contigloom.llm import licenses

PHRASES = licenses.PHRASES


def brute(text):
    w = [t.decode() for t in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())]
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({b for _, b in places}))


def check(docs):
    rows = {}
    for r in licenses.scan(docs).collect():
        rows.setdefault(r.doc_id, []).append(tuple(r)[1:6])
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(brute(r.text))
    assert {k: sorted(v, key=str) for k, v in rows.items()} == {k: sorted(v, key=str) for k, v in want.items()}


def test_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_phrases_and_notices(spark):
    notice = list(licenses.NOTICES)[5]
    changed = notice.replace("without", "with no").replace("Software", "program")
    texts = [
        "MIT license mit License, MIT\nLICENSE!",
        "gnu general public gnu general public license cc by cc by",
        "the apache-license é apache license",
        f"before {changed} after {'filler ' * 50} {notice}",
        "permission is hereby granted to no one",
        "Licensed under CC BY-NC 4.0.",
        "KK mit licenſe",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs)
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[3].labels == "mit" and got[3].base_labels == "" and got[3].score == 1.0
    assert got[4].labels == "" and got[4].score == 0.0
    assert got[5].labels == "cc-by,cc-by-nc" and got[5].base_labels == "cc-by"
    spans = [r for r in licenses.spans(docs).where("doc_id = 3").collect()]
    assert len(spans) == 2 and {r.cover == 1.0 for r in spans} == {True, False}


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert licenses.scan(no_docs).collect() == []

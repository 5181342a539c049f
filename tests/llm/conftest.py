import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, cls string, key long, words string, mix_tokens string"


def invented(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "the", "ion", "or", "wh", "é", "st"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ids with several texts, columns with clashing names."""
    long = invented(1, 60_000)
    copy = invented(2, 80)
    rows = [
        (1, copy, "en", "src0"),
        (2, copy, "en", "src0"),
        (3, copy.replace(copy.split()[40], "changed"), None, "src1"),
        (4, None, "en", "src0"),
        (5, "", "de", None),
        (5, "", "de", None),
        (6, " \t\n", "en", "src2"),
        (None, copy, None, None),
        (None, None, None, None),
        (7, long, "en", "src0"),
        (8, long + " more", "en", "src0"),
        (9, "one", "fr", "src3"),
        (9, "another text of one id", "fr", "src3"),
        (9, "another text of one id", "fr", "src3"),
        (10, "x" * 300_000, "en", "src0"),
    ]
    return spark.createDataFrame([(i, t, a, s, None, "c", 7, "w", "m") for i, t, a, s in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

from collections import defaultdict

import pytest

from contigloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, chunk string, nth int"


def brute(rows, chunk):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is not None, turn or 0, (role or "").strip(" ") or "unknown", text or ""))
    out = []
    for conv, turns in talks.items():
        turns.sort()
        for me in sorted({t[2] for t in turns} - {"system"}):
            before = 0
            for at in range(0, len(turns), chunk):
                text, mask = "", []
                for *_, who, said in turns[at : at + chunk]:
                    text += chat.START + ("assistant" if who == me else "system" if who == "system" else f"user name={who}") + "\n"
                    begin = before + len(text)
                    text += said + chat.STOP
                    if who == me:
                        mask.append((begin, before + len(text)))
                n = len(turns[at : at + chunk])
                out.append((conv, me, at // chunk, n, len(mask), before, text, mask))
                before += len(text)
    return sorted(out, key=str)


def got(df, chunk):
    return sorted(((*tuple(r)[:7], [tuple(s) for s in r.mask]) for r in chat.perspectives(df, chunk).collect()), key=str)


ROWS = [
    (1, 0, "system", "Be kind."),
    (1, 1, "anna", "Hé?"),
    (1, 2, "bob", "Yes"),
    (1, 3, "carl", ""),
    (1, 4, "anna", None),
    (2, 0, "system", "alone"),
    (3, 5, None, "who"),
    (3, 5, " ", "who"),
    (3, None, "user", "first"),
    (None, 0, "user", "no id"),
    (None, 1, "assistant", "x" * 100_000),
    *[(4, i // 3, "user" if i % 2 else "assistant", f"t{i % 5}") for i in range(200)],
    *[(5, i * 3000, "user", "far") for i in range(5)],
    *[(6, i, ["user", "assistant", "anna"][i % 3], f"turn {i}" + "é" * (i % 11)) for i in range(2000)],
]


@pytest.mark.parametrize("chunk", [7, 512])
def test_equals_plain_rendering(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "TILE", 10)
    df = spark.createDataFrame([(*r, "c", 1) for r in ROWS], SCHEMA)
    assert got(df, chunk) == brute(ROWS, chunk)


def test_masks_of_a_long_conversation_hold_in_its_whole_text(spark):
    """2,000 turns at the default size: chunks put together are the dialogue, and every mask marks what its speaker says."""
    df = spark.createDataFrame([(*r, "c", 1) for r in ROWS if r[0] == 6], SCHEMA)
    views = defaultdict(list)
    for r in chat.perspectives(df).collect():
        views[r.perspective].append(r)
    assert set(views) == {"user", "assistant", "anna"}
    for me, chunks in views.items():
        chunks.sort(key=lambda r: r.chunk)
        assert len(chunks) == 4
        whole = "".join(r.text for r in chunks)
        assert [whole[r.first_char :].startswith(r.text) for r in chunks] == [True] * 4
        said = [whole[s.start : s.end] for r in chunks for s in r.mask]
        assert said == [t + chat.STOP for _, _, who, t in sorted(x for x in ROWS if x[0] == 6) if who == me]


def test_empty(spark):
    assert chat.perspectives(spark.createDataFrame([], SCHEMA)).collect() == []

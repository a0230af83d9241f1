"""Small tables for the tests of the text operators."""

from __future__ import annotations

import random

SYLLABLES = "an the er in on st ou re th ha en de ti or wh ly ble ness ing ka mo lu".split()


def words(rnd: random.Random, n: int) -> list[str]:
    return ["".join(rnd.choices(SYLLABLES, k=rnd.randint(1, 3))) for _ in range(n)]


def prose(rnd: random.Random, n: int) -> str:
    """n words in sentences of 5 to 12 words."""
    out, held = [], []
    for w in words(rnd, n):
        held.append(w)
        if len(held) >= rnd.randint(5, 12):
            out.append(" ".join(held).capitalize() + ".")
            held = []
    return " ".join(out + ([" ".join(held)] if held else []))


def awkward(spark, rows: list[tuple]):
    """(doc_id, text) rows with further columns whose names operators use inside."""
    full = [(i, t, 1.5, None, "x") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, score double, id long, kept string")


EDGE = [
    (1, ""),
    (2, None),
    (None, "Without an id. It has a text though."),
    (None, "Without an id. It has a text though."),
    (3, "A"),
    (4, "a"),
    (4, "a"),
    (5, "é É ß 日本語 🙂 <|endoftext|> end"),
    (6, " \t\n "),
    (7, "word " * 3000),
    (8, "x" * 5000),
]

"""Small fixtures for the corpus operators."""

from __future__ import annotations

import random

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = " \t\n\x0b\x0c\r"
#: Texts that try every operator: nulls, empties, white space, odd letters, long runs, repeated rows.
ODD = [(None, "a null id"), (7001, None), (7002, ""), (7003, " \t\r\n"), (7004, "é ß İ ÀÉ \U0001f600 zero\x00byte"), (7005, "x" * 50_000), (7006, "word " * 20_000), (7007, "\n" * 3000), (7008, "same row"), (7008, "same row"), (-5, "negative id")]
DOC = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, h1 long, part long, comp long, line string, _doc long, _row string, "
    "_dropped long, _lines string, _kept string, _gone long, doc string, row long, id string, same string, lines string, kept string, dropped string, `a.b` string"
)
CLASHING = (5, "r", 6, "l", "k", 7, "d", 8, "i", "s", "ls", "ks", "dr", "dot")


def untouched(rows):
    """Whether the columns that no operator may change are as `frame` made them."""
    return all(tuple(r[-len(CLASHING) :]) == CLASHING and tuple(r[5:11]) == (0.5, 1, 2, 3, 4, "x") for r in rows)


def prose(rng: random.Random, words: int) -> str:
    stems = ["the", "of", "and", "tion", "ing", "er", "an", "re", "on", "at", "en", "nd"]
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(words))


def frame(spark, rows):
    """Documents with a hot source and extra columns whose names clash with those the operators use."""
    full = [(i, t, "en", "hot" if k % 3 else None if k % 7 == 0 else f"s{k % 4}", 0, 0.5, 1, 2, 3, 4, "x", *CLASHING) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOC)

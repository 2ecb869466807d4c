"""Awkward documents and plain versions of the operators."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars int, keep_id string, hash int, kept int, "
          "fp string, word string, ranges string, now string, bin int, __text string")


def documents(spark, rows):
    """A frame of (doc_id, text) rows with extra columns whose names clash with those used inside."""
    return spark.createDataFrame(
        [(i, t, None, "s", None if t is None else len(t), "x", 1, 1, "f", "w", "r", "n", 2, "t") for i, t in rows],
        SCHEMA).repartition(3)


def prose(n: int, seed: int, vocabulary: int = 3000) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def awkward() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, repeated rows, ties, copies, near copies, long words and a long text."""
    base = prose(300, 1)
    words = base.split()
    near = " ".join(words[:150] + ["changed"] + words[151:])
    return [(1, base), (2, base.upper()), (3, base), (3, base), (4, near), (5, None), (6, ""), (7, " \t\n "),
            (None, base), (None, None), (8, "one"), (9, "one two"), (10, "x" * 200_000), (11, prose(60_000, 2)),
            (12, "É " * 60 + "ß"), (13, "line a\nline b\nline c\n\n" * 5), (14, "line a\nline b\nother"),
            (15, prose(80, 3) + " " + " ".join(words[100:160]) + " " + prose(50, 4)), (16, "a b ▁c ﷐")]

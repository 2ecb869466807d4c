"""Quality rules as a bitmask ledger.

Every text is measured once; every rule is evaluated once on the measurements
and sets one bit where it fails. Policies are versioned sets of rules: applying
one is a bitwise AND on the stored ledger, and so are ablations (what a policy
would keep without one of its rules).

Defined cases: null text has no words; rows are judged one by one, so repeated
rows and ties get equal results; an empty table gives an empty ledger; other
columns of the input are carried along.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcstrata.llm.common import plain_names

# Rules fail where the condition holds. The position in this list is the bit.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_phrases", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("capitals", "2 * n_capitals > n_letters"),
    ("exclamations", "5 * n_exclamations > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
POLICIES = {
    "base": ("few_words", "repeated_phrases"),
    "v1": tuple(name for name, _ in RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_letters", "n_capitals", "n_exclamations")

# Classes of characters; letters outside the basic plane count as others.
OTHER, CAPITAL, LETTER, SYMBOL, SPACE, EXCLAMATION = range(6)


def character_classes() -> np.ndarray:
    classes = np.zeros(0x10000, np.uint8)
    for code in range(0x10000):
        if chr(code).isalpha():
            classes[code] = CAPITAL if chr(code).isupper() else LETTER
    classes[[ord(c) for c in "#*$%&|<>"]] = SYMBOL
    classes[[0x20, *range(0x09, 0x0E)]] = SPACE
    classes[ord("!")] = EXCLAMATION
    return classes


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, first ones included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, which, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[which] > 1)
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[starts + shift] = True
    return int(covered.sum())


def measured(text: str, classes: np.ndarray) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at \x20 and \x09-\x0D only
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(classes[np.minimum(codes, 0xFFFF)], minlength=6)
    seen, lines, repeated = set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            repeated += line in seen
            seen.add(line)
    return (len(words), int(codes.size - kinds[SPACE]), int(kinds[SYMBOL]), repeated, repeated_words(words),
            lines, int(kinds[CAPITAL] + kinds[LETTER]), int(kinds[CAPITAL]), int(kinds[EXCLAMATION]))


def measurements(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The ``carry`` columns and all measurements of every row's text."""
    fields = docs.select(carry).schema
    schema = fields
    for name in MEASURES:
        schema = schema.add(f"m_{name}", "long")

    def run(batches):
        classes = character_classes()
        for batch in batches:
            rows = [measured(t or "", classes) for t in batch.column("__measured").to_pylist()]
            columns = zip(*rows) if rows else [[]] * len(MEASURES)
            kept = [batch.column(i) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array(c, pa.int64()) for c in columns],
                names=list(carry) + [f"m_{n}" for n in MEASURES])

    return docs.select(*carry, F.col("text").cast("string").alias("__measured")).mapInArrow(run, schema)


def failures(prefix: str = "m_") -> Column:
    """Failure bits of all rules from measurement columns."""
    def named(condition: str) -> str:
        return " ".join(prefix + w if w in MEASURES else w for w in condition.split())
    return reduce(lambda a, b: a + b, [F.when(F.expr(named(c)), F.lit(BIT[n]).cast("long")).otherwise(0)
                                       for n, c in RULES])


def ledger(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` columns, measurements (``m_...``) and ``failed`` bits; a name in ``carry`` may be anything."""
    return measurements(docs, carry).withColumn("m_failed", failures())


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def passes(policy: str) -> Column:
    return F.col("m_failed").bitwiseAND(mask(policy)) == 0


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: rows that fail it, that fail it alone, and that would be kept without it.

    The ledger is first counted by its bit pattern, a few hundred rows at most.
    """
    whole = mask(policy)
    patterns = entries.groupBy(F.col("m_failed").bitwiseAND(whole).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit"))
                                for r in POLICIES[policy]]))
    without = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0
    fails = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return (patterns.withColumn("r", rules).groupBy("r.rule")
            .agg(F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("failed"),
                 F.sum(F.when(fails & without, F.col("n")).otherwise(0)).alias("failed_alone"),
                 F.sum(F.when(without, F.col("n")).otherwise(0)).alias("kept_without")))


def keep(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs`` that pass a policy, with all their columns.

    Columns are renamed while they pass through, so any names will do.
    """
    plain, name = plain_names(docs)
    held = plain.withColumn("text", F.col(name["text"]))
    return ledger(held, plain.columns).filter(passes(policy)).select(plain.columns).toDF(*docs.columns)

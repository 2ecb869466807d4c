"""SimHash near-dedup with deletion-variant signatures.

Two fingerprints that differ in at most three bits differ in at most one bit in
one of their two 32-bit halves. Every distinct fingerprint is indexed under all
one-wildcard variants of both halves (64 keys), so such a pair shares a key.
Rows are shuffled by key, sorted, and streamed: the fingerprints under one key
are compared bit by bit, and only links that join something new come out, never
all pairs. A pair whose half is equal meets under all 32 wildcards and is looked
at under the first only: other wildcards need both values of their bit.

A key with more than ``WIDE`` fingerprints is not compared in place. Its members
are indexed once more by one-wildcard variants of the 16-bit quarters of the
other half; such a key has four free bits at most next to one free quarter,
2 ** 18 fingerprints, so nothing unbounded meets in one task and no pair is lost.

Components are found over distinct fingerprints, so a group of copies is one
node. Defined cases: null text is empty; no words give fingerprint zero, linked
like any other; fewer words than a shingle are one shingle; a null doc_id never
is the smallest unless all of its component are null; an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcstrata.llm.bloom import flagged, seen_once
from srcstrata.llm.common import hex64, plain_names, texts
from srcstrata.llm.components import components
from srcstrata.session import stored

SHINGLE, MAX_BITS, SEED = 3, 3, 42
WIDE = 4096
_BLOCK = 1 << 16


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and \x20 \x09-\x0D only
    if not words:
        return 0
    n = min(shingle, len(words))
    total = len(words) - n + 1
    hashes = map(partial(xxhash.xxh64_intdigest, seed=SEED),
                 map(b" ".join, zip(*(words[i:] for i in range(n)))))
    counts = np.zeros(64, np.int64)
    for start in range(0, total, _BLOCK):
        block = np.fromiter(hashes, np.uint64, min(_BLOCK, total - start))
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    def run(batches):
        for batch in batches:
            values = np.fromiter((simhash(t, shingle) for t in batch.column("text").to_pylist()),
                                 np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))],
                                             names=["doc_id", "fp"])
    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def _halves(prints: DataFrame) -> DataFrame:
    """64 keys for every fingerprint; ``own`` is the bit under the wildcard, 2 for the first wildcard."""
    half = F.expr("if(v < 32, fp & 4294967295, shiftrightunsigned(fp, 32))")
    return (prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
            .withColumn("half", half)
            .select("fp",
                    F.expr("shiftleft(bigint(v), 32) | (half & ~shiftleft(1L, v % 32))").alias("key"),
                    F.expr("int(if(v % 32 = 0, 2, shiftright(half, v % 32) & 1))").alias("own")))


def _quarters(wide: DataFrame) -> DataFrame:
    """32 keys under a wide key, cut from the half that the wide key leaves open."""
    return (wide.select("key", "fp", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("w"))
            .withColumn("quarter", F.expr(
                "shiftrightunsigned(if(shiftright(key, 32) < 32, shiftrightunsigned(fp, 32), fp & 4294967295),"
                " if(w < 16, 0, 16)) & 65535"))
            .select("fp",
                    F.expr("shiftleft(key, 21) | shiftleft(bigint(w), 16)"
                           " | (quarter & ~shiftleft(1L, w % 16))").alias("key"),
                    F.expr("int(if(w % 16 = 0, 2, shiftright(quarter, w % 16) & 1))").alias("own")))


def spanning_links(prints: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Links within ``max_bits`` that connect what is connected, one per fingerprint at most."""
    left = prints
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= max_bits
            if near.any():
                queue.extend(left[near])
                yield from ((int(at.view(np.int64)), int(x)) for x in left[near].view(np.int64))
                left = left[~near]


def _compared(keyed: DataFrame, max_bits: int, wide: int | None) -> DataFrame:
    """(a, b, key): links under every key, or with a null b the members of a key that is too wide."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])

    def emit(rows):
        columns = zip(*rows) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], schema=schema)

    def close(key, prints, own, out):
        if prints.size < 2 or (own.min() == own.max() and own[0] < 2):
            return
        out.extend((a, b, None) for a, b in spanning_links(np.unique(prints).view(np.uint64), max_bits))

    def run(batches):
        held, open_key, passing = [], None, False  # parts of the key at the end of the last batch
        for batch in batches:
            keys = batch.column("key").to_numpy()
            prints = batch.column("fp").to_numpy()
            own = batch.column("own").to_numpy()
            out = []
            edges = np.flatnonzero(np.diff(keys)) + 1
            starts = np.concatenate([[0], edges]) if keys.size else np.empty(0, int)
            ends = np.concatenate([edges, [keys.size]]) if keys.size else np.empty(0, int)
            last = len(starts) - 1
            worth = (ends - starts > 1) | (np.arange(len(starts)) == last) | (np.arange(len(starts)) == 0)
            for i in np.flatnonzero(worth):
                key, s, e = int(keys[starts[i]]), starts[i], ends[i]
                if i == 0 and key != open_key and open_key is not None:
                    if not passing:
                        close(open_key, *map(np.concatenate, zip(*held)), out)
                    held, open_key, passing = [], None, False
                if i == 0 and key == open_key or i == last:
                    open_key = key
                    if passing:
                        out.extend((int(f), None, key) for f in prints[s:e])
                    else:
                        held.append((prints[s:e], own[s:e]))
                        if wide is not None and sum(len(p) for p, _ in held) > wide:
                            out.extend((int(f), None, key) for p, _ in held for f in p)
                            held, passing = [], True
                    if i != last:
                        if not passing:
                            close(open_key, *map(np.concatenate, zip(*held)), out)
                        held, open_key, passing = [], None, False
                elif wide is not None and e - s > wide:
                    out.extend((int(f), None, key) for f in prints[s:e])
                else:
                    close(key, prints[s:e], own[s:e], out)
            yield emit(out)
        if held:
            out = []
            close(open_key, *map(np.concatenate, zip(*held)), out)
            yield emit(out)

    return (keyed.repartition("key").sortWithinPartitions("key", "fp")
            .mapInArrow(run, "a long, b long, key long"))


def links(prints: DataFrame, max_bits: int = MAX_BITS, wide: int = WIDE) -> DataFrame:
    """(a, b): links between distinct fingerprints ``prints(fp)`` that connect all components."""
    if max_bits > 3:
        raise ValueError("two halves with one wildcard find pairs of at most three differing bits")
    first = stored(_compared(_halves(prints), max_bits, wide), "simhash-links")
    second = _compared(_quarters(first.filter("b IS NULL").select("key", F.col("a").alias("fp"))), max_bits, None)
    return first.filter("b IS NOT NULL").select("a", "b").union(second.select("a", "b"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, wide: int = WIDE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs(doc_id, text)``."""
    prints = stored(fingerprints(docs, shingle), "simhash")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), max_bits, wide))
    rooted = (distinct.join(roots, F.col("fp") == F.col("node"), "left")
              .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = rooted.join(smallest, "root").select(F.col("fp").alias("__fp"), "component_id")
    return (prints.join(known, F.col("fp") == F.col("__fp"))
            .select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id"))


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of every component the smallest id.

    Ids to drop go into a bounded Bloom filter; rows it does not know pass
    straight through, the others are checked by a join. Rows that share an id
    go only if all of them have another representative; null ids stay.
    """
    verdicts = near_duplicates(docs, shingle, max_bits)
    drop = stored(verdicts.filter("doc_id IS NOT NULL").groupBy("doc_id")
                  .agg(F.min(F.col("doc_id") != F.col("component_id")).alias("goes"))
                  .filter("goes").select("doc_id"), "simhash-drop")
    plain, name = plain_names(docs)
    marked = flagged(plain.withColumn("__id", F.col(name["doc_id"]).cast("long")), "__id",
                     seen_once(drop, "doc_id"), "__maybe")
    gone = drop.withColumnRenamed("doc_id", "__gone")
    checked = marked.filter("__maybe").join(gone, F.col("__id") == F.col("__gone"), "left_anti")
    return (marked.filter("__id IS NULL OR NOT __maybe").select(plain.columns)
            .unionByName(checked.filter("__id IS NOT NULL").select(plain.columns)).toDF(*docs.columns))

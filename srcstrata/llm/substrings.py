"""Substring dedup: passages that recur are found, confirmed, compiled and located.

1. *Find.* Every 35-word window has one anchor: the first of the smallest hashes
   of its 8-word grams. Equal windows have equal anchors at equal places, so the
   windows of a document fall into segments, one per anchor, about 2 for every
   29 words. Only (anchor, segment hash) rows are counted. An anchor that occurs
   once holds no repeated window.
2. *Confirm.* Where all segments of an anchor are equal, all their windows recur.
   Where they differ (at the ends of passages), their windows are counted by
   their own hashes, which needs the texts of those documents only.
3. *Compile.* A run of confirmed windows is a passage. Documents with passages are
   dealt out in blocks, and each block's distinct passages are compiled into one
   Aho-Corasick automaton over its words, a shard of bounded size. A passage that
   any number of documents hold is compiled once per block, never gathered.
4. *Locate.* The block's documents are streamed through their automaton; all
   occurrences of all passages are removed. Documents without passages have no
   occurrence to find and pass straight through.

Hashes are equal by 64-bit anchor and 64-bit window or segment together. Defined
cases: null text has no words; documents shorter than a window lose nothing;
rows are told apart by (doc_id, text hash), and repeated rows count as documents
of their own and get equal results; an empty table gives an empty one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcstrata.llm.bloom import flagged, seen_once
from srcstrata.llm.common import rows_of, slices, texts
from srcstrata.session import stored

WINDOW, GRAM = 35, 8
BLOCK_WORDS = 500_000
REMEMBERED = 300_000
ROWS_OUT = 100_000  # of small columns in a batch that a task hands on
LETTERS = sys.maxunicode
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Rolling:
    """Polynomial hashes of any word range of one document."""

    def __init__(self, words: list[bytes], hashes: WordHashes):
        n = len(words)
        values = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers(_BASE, n), out=self.sums[1:])
        self.back = _powers(_BASE_INVERSE, n)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def segments(rolling: Rolling, n: int, window: int, gram: int):
    """(anchor hash, first window, windows, segment hash) arrays of a document of ``n`` words."""
    starts = np.arange(n - gram + 1)
    grams = rolling.of(starts, starts + gram)
    inner = window - gram + 1
    at = np.arange(n - window + 1)
    anchors = at + np.lib.stride_tricks.sliding_window_view(grams, inner).argmin(axis=1)
    first = np.concatenate([[0], np.flatnonzero(np.diff(anchors)) + 1])
    count = np.diff(np.concatenate([first, [at.size]]))
    whole = rolling.of(first, first + count - 1 + window)
    place = (anchors[first] - first).astype(np.uint64)
    return grams[anchors[first]], first, count, _mixed(whole + place)


def _anchors(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("anchor", pa.int64()),
                        ("segment", pa.int64()), ("first", pa.int32()), ("windows", pa.int32())])

    def run(batches):
        hashes = WordHashes()
        for batch in chain.from_iterable(map(slices, batches)):
            parts, owners = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                if len(words) >= window:
                    found = segments(Rolling(words, hashes), len(words), window, gram)
                    parts.append(found)
                    owners.append(np.full(found[0].size, row))
            if not parts:
                continue
            anchor, first, count, segment = map(np.concatenate, zip(*parts))
            rows = pa.array(np.concatenate(owners))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("hash").take(rows),
                 pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64)),
                 pa.array(first, pa.int32()), pa.array(count, pa.int32())], schema=schema)

    return keyed.select("doc_id", "hash", "text").mapInArrow(
        run, "doc_id long, hash long, anchor long, segment long, first int, windows int")


def _ranges(rows: DataFrame, *columns: str) -> DataFrame:
    """Arrays of ``columns`` per document; rows of repeated documents are equal and count once."""
    return (rows.groupBy(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"))
            .agg(F.collect_set(F.struct(*columns)).alias("ranges")))


def _with_ranges(keyed: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with ranges, found by a bounded filter and an exact join, and the others as they are."""
    marked = flagged(keyed, "hash", seen_once(ranges.select("__hash"), "__hash"), "__maybe")
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash"))
    return (marked.filter("__maybe").drop("__maybe").join(ranges, on, "left").drop("__id", "__hash"),
            marked.filter("NOT __maybe").drop("__maybe"))


def _windows(mixed: DataFrame, window: int) -> DataFrame:
    """(doc_id, hash, anchor, at, value): the windows in ``ranges`` with their own hashes."""
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("anchor", pa.int64()),
                        ("value", pa.int64()), ("at", pa.int32())])

    def run(batches):
        hashes = WordHashes()
        for batch in chain.from_iterable(map(slices, batches)):
            held, n = [], 0

            def emit():
                owner, anchor, value, at = map(np.concatenate, zip(*held))
                rows = pa.array(owner)
                return pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("hash").take(rows), pa.array(anchor),
                     pa.array(value.view(np.int64)), pa.array(at, pa.int32())], schema=schema)

            lists = batch.column("ranges")
            anchors, firsts, counts = (lists.flatten().field(c).to_numpy() for c in ("anchor", "first", "windows"))
            end = 0
            for row, text in enumerate(batch.column("text").to_pylist()):
                begin, end = end, end + len(lists[row])
                words = text.encode("utf-8", "surrogatepass").split()
                rolling = Rolling(words, hashes)
                for part in range(begin, end, 4096):
                    some = slice(part, min(part + 4096, end))
                    count = counts[some]
                    at = np.repeat(firsts[some] - np.cumsum(count) + count, count) + np.arange(count.sum())
                    held.append((np.full(at.size, row), np.repeat(anchors[some], count), rolling.of(at, at + window),
                                 at))
                    n += at.size
                    if n >= ROWS_OUT:
                        yield emit()
                        held, n = [], 0
            if held:
                yield emit()

    return mixed.select("doc_id", "hash", "text", "ranges").mapInArrow(
        run, "doc_id long, hash long, anchor long, value long, at int")


def recurring_windows(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, hash, first, windows): runs of windows whose words also start elsewhere."""
    found = stored(_anchors(keyed, window, gram), "substring-anchors")
    # A segment hash stands for all of a segment, so its smallest and largest value tell whether all are equal.
    # Counts are stored before they are joined: both sides of the join then are plain exchanges, which can be split.
    anchors = stored(found.groupBy(F.col("anchor").alias("__anchor"))
                     .agg(F.count("*").alias("n"), F.min("segment").alias("low"), F.max("segment").alias("high"))
                     .filter("n > 1").select("__anchor", (F.col("low") == F.col("high")).alias("equal")),
                     "substring-recurring")
    shared = stored(found.join(anchors, F.col("anchor") == F.col("__anchor")).drop("__anchor", "segment"),
                    "substring-shared")
    # Repeated documents have equal rows here; each of them is an occurrence.
    mixed, _ = _with_ranges(keyed, _ranges(shared.filter("NOT equal"), "anchor", "first", "windows"))
    windows = stored(_windows(mixed.filter("ranges IS NOT NULL"), window), "substring-windows")
    several = stored(windows.groupBy(F.col("anchor").alias("__anchor"), F.col("value").alias("__value"))
                     .agg(F.count("*").alias("n")).filter("n > 1").select("__anchor", "__value"),
                     "substring-several")
    confirmed = windows.join(several, (F.col("anchor") == F.col("__anchor")) & (F.col("value") == F.col("__value")))
    return (shared.filter("equal").select("doc_id", "hash", "first", "windows")
            .union(confirmed.select("doc_id", "hash", "at", F.lit(1).alias("windows"))))


def passages(ranges: list[dict], window: int) -> list[tuple[int, int]]:
    """Word spans of maximal runs of consecutive confirmed windows."""
    spans: list[list[int]] = []
    for first, last in sorted((r["first"], r["first"] + r["windows"] - 1) for r in ranges):
        if spans and first <= spans[-1][1] + 1:
            spans[-1][1] = max(spans[-1][1], last)
        else:
            spans.append([first, last])
    return [(a, b + window) for a, b in spans]


def located(documents: list[bytes], phrases: list[list[tuple[int, int]]]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Per document its words and a mask of those in any occurrence of any of the block's phrases.

    A word of a phrase is a letter and a phrase a string, or a tuple of numbers
    where there may be more words than letters. One document's words are held at
    a time.
    """
    import ahocorasick
    some = sum(b - a for spans in phrases for a, b in spans)
    if not some:
        for text in documents:
            words = text.split()
            yield words, np.zeros(len(words), bool)
        return
    kind, letter, key, other = ((ahocorasick.KEY_STRING, chr, "".join, "\0") if some < LETTERS else
                                (ahocorasick.KEY_SEQUENCE, int, tuple, 0))
    letters: dict[bytes, str | int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, kind)
    for text, spans in zip(documents, phrases):
        words = text.split() if spans else []
        for a, b in spans:
            automaton.add_word(key([letters.get(w) or letters.setdefault(w, letter(len(letters) + 1))
                                    for w in words[a:b]]))
    automaton.make_automaton()
    for text in documents:
        words = text.split()
        gone = np.zeros(len(words) + 1, np.int32)
        for end, length in automaton.iter(key([letters.get(w, other) for w in words])):
            gone[end + 1 - length] += 1
            gone[end + 1] -= 1
        yield words, np.cumsum(gone[:-1]) > 0


def _removed(df: DataFrame, window: int) -> DataFrame:
    def block(held):
        ids, documents, spans = zip(*held)
        out = []
        for document, (words, gone) in zip(ids, located(documents, spans)):
            out.append((document, len(words), int(gone.sum()), b" ".join(compress(words, (~gone).tolist()))))
        columns = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
            names=["doc_id", "n_words", "n_removed", "kept"])

    def run(batches):
        held, size = [], 0
        for batch in chain.from_iterable(map(slices, batches)):
            for document, text, ranges in rows_of(batch, "doc_id", "text", "ranges"):
                held.append((document, text.encode("utf-8", "surrogatepass"), passages(ranges or [], window)))
                size += len(text) // 6 + 1
                if size >= BLOCK_WORDS:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    return df.select("doc_id", "text", "ranges").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept binary")


def remove_repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words of every row, joined by one space, as UTF-8 bytes."""
    keyed = texts(docs).withColumn("hash", F.xxhash64("text"))
    runs = stored(_ranges(recurring_windows(keyed, window, gram), "first", "windows"), "substring-runs")
    held, free = _with_ranges(keyed, runs)
    nothing = F.array().cast("array<struct<first:int,windows:int>>")
    return (_removed(held.withColumn("ranges", F.coalesce("ranges", nothing)), window)
            .unionByName(_removed(free.withColumn("ranges", nothing), window)))

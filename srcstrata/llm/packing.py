"""Hierarchical best-fit packing of token sequences.

Texts are tokenised once, in place. Only documents longer than a sequence are
cut, the first piece taking what is left over, so that all others are full.
Every task packs its own pieces best-fit in decreasing order: full and nearly
full bins are done, the others go on as items of their bins' sizes. Rounds then
deal these items out anew to ever fewer tasks of ``ITEMS`` items at most, until
one task is enough or a round no longer saves bins. No task ever holds more than
its share, whatever the input's size.

Token ids are those of the vocabulary file's tokenizer. They are computed by a
faster library from the same file's vocabulary, whose merges are in the order of
their ids, a whole text at a time: most words of a large table are rare, and
remembering them costs more than encoding them again. Defined cases: null text is empty, a
document of the end token alone; the file's added tokens are found in texts, as
its tokenizer finds them, and what stands between them is encoded alone;
repeated rows and null ids are documents of their own; an empty table gives an
empty one.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcstrata.llm.common import rows_of, texts
from srcstrata.session import stored

CAPACITY, END, NEARLY_FULL, ITEMS = 1024, 2, 0.995, 100_000


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable ones for themselves, others from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokens:
    """Token ids of whole texts by a byte-level BPE vocabulary file.

    With ``added``, the file's added tokens get their ids where texts hold them;
    without, they are ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            loaded = json.load(f)
        byte_of = byte_characters()
        special = {t["content"]: t["id"] for t in loaded.get("added_tokens", ())}
        if added and any(t.get(k) for t in loaded.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("an added token takes more or less than its own characters")
        self.added = special if added else {}
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        ranks = {bytes(byte_of[c] for c in token): i
                 for token, i in loaded["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text."""
        if not any(token in text for token in self.added):
            return self._ordinary(text)
        parts = [np.array([self.added[part]], "<u4") if part in self.added else self._ordinary(part)
                 for part in self.between.split(text) if part]
        return np.concatenate(parts)

    def _ordinary(self, text: str) -> np.ndarray:
        """Ids of ordinary text."""
        return self.encoding.encode_to_numpy(text, disallowed_special=())


# Fixed value: the splitting pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of every item. Bins are counted by what they have left."""
    bins = np.empty(len(sizes), np.int64)
    offsets = np.empty(len(sizes), np.int64)
    free: dict[int, list[int]] = {}  # space left -> bins
    spaces: list[int] = []  # spaces that some bin has, in order
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(spaces, size)
        if at < len(spaces):
            space = spaces[at]
            chosen = free[space].pop()
            if not free[space]:
                spaces.pop(at)
        else:
            space, chosen, made = capacity, made, made + 1
        bins[i], offsets[i] = chosen, capacity - space
        rest = space - size
        if rest:
            if not free.get(rest):
                free.setdefault(rest, [])
                spaces.insert(bisect_left(spaces, rest), rest)
            free[rest].append(chosen)
    return bins, offsets


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than a sequence."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def _numbers() -> tuple[int, int]:
    """Where this task's bin numbers begin: tasks of a stage differ in their partition."""
    from pyspark import TaskContext
    return TaskContext.get().partitionId() << 32, 0


def _pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """Pieces of all documents, packed within their task."""
    names = [x.split()[0] for x in _PIECES.split(", ")]
    kinds = [pa.int32() if n == "piece" else pa.int64() for n in names]

    def packed(rows, base):
        lengths = np.array([r[3] for r in rows], np.int64)
        bins, offsets = pack(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)[bins]
        columns = [*zip(*rows), bins + base, offsets, fill]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names), bins.max() + 1

    def run(batches):
        tokens, (base, used) = Tokens(path, added=True), _numbers()
        rows = []
        for batch in batches:
            for document, text in rows_of(batch, "doc_id", "text"):
                ids = np.append(tokens.ids(text), np.uint32(END)).astype("<u4")
                rows += [(document, i, s, n, zlib.crc32(ids[s:s + n].tobytes()))
                         for i, (s, n) in enumerate(cut(len(ids), capacity))]
                if len(rows) >= ITEMS:
                    out, more = packed(rows, base + used)
                    yield out
                    rows, used = [], used + more
        if rows:
            yield packed(rows, base + used)[0]

    return texts(docs).mapInArrow(run, _PIECES)


def _merged(items: DataFrame, tasks: int, capacity: int, round_number: int) -> DataFrame:
    """(bin, size) items packed into new bins by ``tasks`` tasks: adds new_bin, shift and fill."""
    def run(batches):
        base, used = _numbers()
        base += round_number << 56
        ids, sizes = [], []

        def emit():
            sized = np.concatenate(sizes)
            bins, offsets = pack(sized, capacity)
            fill = np.bincount(bins, weights=sized).astype(np.int64)[bins]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(ids)), pa.array(bins + base + used), pa.array(offsets), pa.array(fill)],
                names=["bin", "new_bin", "shift", "fill"]), int(bins.max()) + 1
        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column("bin").to_numpy())
                sizes.append(batch.column("size").to_numpy())
            if sum(map(len, ids)) >= 2 * ITEMS:
                out, more = emit()
                yield out
                used, ids, sizes = used + more, [], []
        if ids:
            yield emit()[0]

    return (items.repartition(tasks, F.xxhash64("bin", F.lit(round_number)))
            .mapInArrow(run, "bin long, new_bin long, shift long, fill long"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row."""
    pieces = stored(_pieces(docs, path, capacity), "packing-pieces")
    enough = int(capacity * NEARLY_FULL)
    # Bins still open, and where every bin of the first round has gone so far.
    open_bins = pieces.filter(F.col("fill") < enough).groupBy("bin").agg(F.max("fill").alias("size"))
    moved = stored(open_bins.select("bin", F.col("bin").alias("now"), F.lit(0).cast("long").alias("shift"), "size"),
                   "packing-moves")
    items = moved.select("bin", "size")
    n, round_number = items.count(), 0
    while n > 1:
        round_number += 1
        tasks = -(-n // ITEMS)
        packed = stored(_merged(items, tasks, capacity, round_number), "packing-round")
        steps = packed.select(F.col("bin").alias("was"), "new_bin", F.col("shift").alias("by"), "fill")
        moved = stored(moved.join(steps, F.col("now") == F.col("was"), "left").select(
            moved["bin"], F.coalesce("new_bin", "now").alias("now"),
            (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift"), F.coalesce("fill", "size").alias("size")),
            "packing-moves")
        items = packed.filter(F.col("fill") < enough).groupBy(F.col("new_bin").alias("bin")).agg(
            F.max("fill").alias("size"))
        left = items.count()
        if tasks == 1 or left > 0.99 * n:
            break
        n = left
    final = moved.select(F.col("bin").alias("__bin"), "now", "shift")
    return (pieces.join(final, F.col("bin") == F.col("__bin"), "left")
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    F.coalesce("now", "bin").alias("sequence_id"),
                    (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")))

"""Alignment of two tokenizers' tokens over the same text.

Token borders come from the tokenizers' own spans: character offsets of the
byte-level BPE file (A), byte spans of the SentencePiece model's proto (B, whose
added space is the text's first). Spans are coarse: tokens that share a
character's bytes all claim the character, and a byte-fallback piece claims what
its neighbours say. Such tokens get their ends from their decoded bytes
(:meth:`Aligner.ends_a`, :meth:`Aligner.ends_b`). Offsets where tokens of both end
cut the tokens into groups, and tokens of one group are linked.

Both tokenizers begin a token at a single space between two other characters
(checked against B's pieces when the model is read), so a text is aligned in the
stretches between such spaces, and a stretch seen before is not aligned again,
``REMEMBERED`` at most in a task. A document keeps places of its distinct
pairs in a list of pairs that a block of documents shares. Only these lists are
exploded, counted and joined: a pair that every document holds is a row per
block and not per document. A block (``BLOCK`` links, one document at least) then
meets its counted list again. Nothing is collected, and nothing is broadcast.

Defined cases: null and empty texts, and texts whose joined tokens of A or of B
are not the bytes of space + text (one with U+2581, for one), have zeros and an
empty digest and count for no pair; repeated rows and null ids are documents of
their own; ties for an A id's highest count are all best; other columns are not
read, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcstrata.llm.common import rows_of, texts
from srcstrata.llm.packing import byte_characters
from srcstrata.session import stored

# Remembered stretches, links of a block, characters cut, stretches aligned and encoded as one text at a time.
REMEMBERED, BLOCK, BATCH, TOGETHER, SIDE_BY_SIDE = 300_000, 1_500_000, 500_000, 8192, 32

# A single space between two other characters begins a stretch.
STRETCH = re.compile(r"(?<=\S)(?= \S)")
# A word and the signs after it: A always begins a token there, and B if no piece has both.
WORD_AND_SIGNS = regex.compile(r"( \p{L}+)([^\w\s▁]+)")
WORD_BEFORE_SIGN = regex.compile(r"\p{L}[^\w\s▁]")
WORD = " a"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")

_ALIGNED = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "places array<int>, times array<int>, pairs array<long>, held array<int>, of_block boolean")


class Aligner:
    """Groups of tokens of both tokenizers over a stretch of text that begins with the added or a real space."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = byte_characters()
        self.bytes_a = {i: bytes(byte_of[c] for c in token) for token, i in self.a.get_vocab(False).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes on after a space: texts cannot be aligned in stretches")
        signed = [p for i, p in enumerate(pieces) if not (
            self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i)) and WORD_BEFORE_SIGN.search(p)]
        self.cuts_words = not signed  # no piece goes on from a word into the signs after it
        self.fallback = [bool(_BYTE.fullmatch(p)) for p in pieces]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if f else p.replace("▁", " ").encode()
                        for p, f in zip(pieces, self.fallback)]

        self.is_byte = np.array(self.fallback)
        self.size_a = np.zeros(1 + max(self.bytes_a), np.int64)
        self.size_a[list(self.bytes_a)] = list(map(len, self.bytes_a.values()))
        self.size_b = np.array(list(map(len, self.bytes_b)))

    @staticmethod
    def says(table, ids: list[int], text: str) -> bool:
        return b"".join([table[i] for i in ids]) == text.encode()

    def encoded(self, stretches: list[str]):
        """(stretch, A's encoding, B's proto) of each."""
        return zip(stretches, self.a.encode_batch(stretches, add_special_tokens=False),
                   self.b.encode([s[1:] for s in stretches], return_type="proto", num_threads=1))

    def ends_a(self, stretch: str, encoding) -> list[int]:
        """Byte end of every token."""
        starts = [0, *accumulate(map(len, map(str.encode, stretch)))]  # of characters, and the whole length
        ids, spans, ends, at = encoding.ids, encoding.offsets, [], 0
        for i, (_, end) in enumerate(spans):
            shared = i + 1 < len(spans) and spans[i + 1][0] < end  # the next token has bytes of this character
            at = at + len(self.bytes_a[ids[i]]) if shared else starts[end]
            ends.append(at)
        return ends

    def ends_b(self, pieces) -> list[int]:
        """Byte end of every piece, the first space included."""
        ends, at = [], 0
        for i, p in enumerate(pieces):
            odd = self.fallback[p.id] or i + 1 < len(pieces) and self.fallback[pieces[i + 1].id]
            at = at + len(self.bytes_b[p.id]) if odd else p.end + 1
            ends.append(at)
        return ends

    def aligned(self, stretch: str, encoding, proto):
        """(n_a, n_b, groups as [(a ids, b ids)]), or None where the bytes of either differ from the stretch."""
        ids_a, pieces = encoding.ids, proto.pieces
        ids_b = [p.id for p in pieces]
        if not self.says(self.bytes_a, ids_a, stretch) or not self.says(self.bytes_b, ids_b, stretch):
            return None
        ends_a, ends_b = self.ends_a(stretch, encoding), self.ends_b(pieces)
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            k, m = i, j
            while i < len(ends_a) and ends_a[i] <= cut:
                i += 1
            while j < len(ends_b) and ends_b[j] <= cut:
                j += 1
            groups.append((ids_a[k:i], ids_b[m:j]))
        return len(ids_a), len(ids_b), groups


class Stretches:
    """Aligned stretches: numbers, digests and pairs, remembered."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.text = list(map(str, range(1 + max(max(aligner.bytes_a), len(aligner.bytes_b)))))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.said: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links; -1 where bytes differ
        self.starts, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn_all(self, stretches: list[str], numbers: list[int | None]) -> np.ndarray:
        """Numbers of stretches, with those aligned now that had none."""
        if None in numbers:
            unknown = list(dict.fromkeys(s for s, n in zip(stretches, numbers) if n is None))
            if len(self.said) + len(unknown) > REMEMBERED:
                self.clear()
                unknown = list(dict.fromkeys(stretches))
            for start in range(0, len(unknown), TOGETHER):
                self.learn(unknown[start:start + TOGETHER])
            numbers = list(map(self.number.__getitem__, stretches))
        return np.array(numbers, np.int64)

    def learn(self, unknown: list[str]) -> None:
        """Aligns new stretches: a word and the signs after it from what both are, others from their text."""
        split = [WORD_AND_SIGNS.fullmatch(s) if self.aligner.cuts_words else None for s in unknown]
        whole = dict.fromkeys(s if m is None else m[1] for s, m in zip(unknown, split))
        signs = dict.fromkeys(m[2] for m in split if m is not None)
        self._learn_whole([s for s in whole if s not in self.number], [s for s in signs if s not in self.number])
        joined = [(s, m) for s, m in zip(unknown, split) if m is not None]
        if not joined:
            return
        number = self.number
        parts = np.array([(number[m[1]], number[m[2]]) for _, m in joined], np.int64)
        sizes = self.sizes[parts].sum(1)
        sizes[(self.sizes[parts, 0] < 0).any(1)] = -1
        said = [f"{self.said[i]};{self.said[j]}" for i, j in parts.tolist()]
        at, n = self.places(parts.ravel())
        self._add([s for s, _ in joined], said, sizes, n.reshape(-1, 2).sum(1), self.pairs[at], self.times[at])

    def _learn_whole(self, unknown: list[str], signs: list[str]) -> None:
        """Side by side those that begin with one space and end without any, others one by one."""
        plain = [i for i, s in enumerate(unknown) if "▁" not in s and not s[-1].isspace() and not s[1].isspace()]
        found = self._plain([unknown[i] for i in plain]) if plain else None
        if found is None:
            plain = []
        else:
            self._add([unknown[i] for i in plain], *found)
        chosen = set(plain)
        odd = [s for i, s in enumerate(unknown) if i not in chosen]
        if odd:
            self._add(odd, *self._odd([self.aligner.aligned(*x) for x in self.aligner.encoded(odd)]))
        if signs:  # after a word, which is taken off again
            after = [self.aligner.aligned(*x) for x in self.aligner.encoded([f"{WORD}{s}" for s in signs])]
            word, = (self.aligner.aligned(*x) for x in self.aligner.encoded([WORD]))
            self._add(signs, *self._odd([None if x is None else (
                x[0] - word[0], x[1] - word[1], x[2][len(word[2]):]) for x in after]))

    def _add(self, stretches: list[str], said, sizes, counts, pairs, times) -> None:
        self.number.update(zip(stretches, range(len(self.said), len(self.said) + len(stretches))))
        self.said += said
        self.sizes = np.concatenate([self.sizes, sizes])
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(counts))
        self.pairs, self.times = np.append(self.pairs, pairs), np.append(self.times, times)

    def places(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pairs of numbered stretches are, one after the other, and how many each has."""
        n = self.starts[numbers + 1] - self.starts[numbers]
        return np.repeat(self.starts[numbers] - (np.cumsum(n) - n), n) + np.arange(n.sum()), n

    def _plain(self, stretches: list[str]):
        """(digest texts, sizes, counts, pairs, times) of stretches, or None where a token has other bytes than its
        end says. ``SIDE_BY_SIDE`` of them are encoded as one text: both tokenizers cut it where they were cut."""
        texts = ["".join(stretches[i:i + SIDE_BY_SIDE]) for i in range(0, len(stretches), SIDE_BY_SIDE)]
        ids_a, from_a, to_a, ids_b, to_b, chars, at = [], [], [], [], [], 0, 0
        for text, a, b in self.aligner.encoded(texts):
            ids_a += a.ids
            spans = a.offsets
            from_a += [chars + x for x, _ in spans]
            to_a += [chars + y for _, y in spans]
            pieces = b.pieces
            ids_b += [p.id for p in pieces]
            to_b += [at + 1 + p.end for p in pieces]
            chars, at = chars + len(text), at + len(text.encode())
        raw, whole = "".join(texts), self.aligner
        if not whole.says(whole.bytes_a, ids_a, raw) or not whole.says(whole.bytes_b, ids_b, raw):
            return None
        codes = np.frombuffer(raw.encode("utf-32-le"), "<u4")
        starts = np.append(0, np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)))
        ids_a, ids_b, to_b = (np.array(x, np.int64) for x in (ids_a, ids_b, to_b))
        from_a, to_a = np.array(from_a, np.int64), np.array(to_a, np.int64)
        bytes_a, bytes_b = np.cumsum(whole.size_a[ids_a]), np.cumsum(whole.size_b[ids_b])
        shared = np.append(from_a[1:] < to_a[:-1], False)  # the next token has bytes of this one's last character
        odd = whole.is_byte[ids_b]
        ends_a = np.where(shared, bytes_a, starts[to_a])
        ends_b = np.where(odd | np.append(odd[1:], False), bytes_b, to_b)
        if (ends_a != bytes_a).any() or (ends_b != bytes_b).any():
            return None
        upto = starts[np.cumsum(np.fromiter(map(len, stretches), np.int64, len(stretches)))]
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        n_a, n_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        stretch = np.searchsorted(upto, cuts, "left")  # of a group
        sizes = np.stack([np.bincount(stretch, w, len(stretches)).astype(np.int64)
                          for w in (n_a, n_b, np.ones(len(cuts)), n_a * n_b)], 1)
        often, first_a, first_b = n_b[group_a], np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        at = np.repeat(first_b[group_a] - (np.cumsum(often) - often), often) + np.arange(often.sum())
        pairs = np.repeat(ids_a, often) << 32 | ids_b[at]
        where = np.repeat(stretch[group_a], often)
        order = np.lexsort((pairs, where))
        pairs, where = pairs[order], where[order]
        new = np.append(True, (pairs[1:] != pairs[:-1]) | (where[1:] != where[:-1])).nonzero()[0]
        text = self.text.__getitem__
        said_a, said_b = list(map(text, ids_a.tolist())), list(map(text, ids_b.tolist()))
        groups = [f"{said_a[i]}|{said_b[j]}" if n == m == 1 else f"{','.join(said_a[i:i + n])}|{','.join(said_b[j:j + m])}"
                  for i, n, j, m in zip(first_a.tolist(), n_a.tolist(), first_b.tolist(), n_b.tolist())]
        upto = np.cumsum(sizes[:, 2]).tolist()
        said = [";".join(groups[i:j]) for i, j in zip([0, *upto], upto)]
        return (said, sizes, np.bincount(where[new], minlength=len(stretches)), pairs[new],
                np.diff(np.append(new, len(pairs))))

    @staticmethod
    def _odd(aligned: list):
        """The same of stretches that were aligned one by one."""
        said, sizes, counts, pairs, times = [], [], [], [], []
        for found in aligned:
            if found is None:
                said.append("")
                sizes.append((-1, -1, -1, -1))
                counts.append(0)
                continue
            n_a, n_b, groups = found
            linked: Counter = Counter()
            for a, b in groups:
                of_b = Counter(b)
                for x, n in Counter(a).items():
                    for y, m in of_b.items():
                        linked[x << 32 | y] += n * m
            said.append(";".join([f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups]))
            sizes.append((n_a, n_b, len(groups), linked.total()))
            counts.append(len(linked))
            pairs += linked.keys()
            times += linked.values()
        return (said, np.array(sizes, np.int64).reshape(-1, 4),
                *[np.array(x, np.int64) for x in (counts, pairs, times)])

    def whole(self, texts: list[str]):
        """Per text: its sizes, digest, distinct pairs and how often each is linked; None where it has no tokens."""
        cut = [stretches_of(t) for t in texts]
        flat = list(chain.from_iterable(cut))
        numbers = self.learn_all(flat, list(map(self.number.get, flat)))
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        starts = np.append(0, ends[:-1])
        sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(
            np.column_stack([self.sizes[numbers], self.sizes[numbers, 0] < 0]), axis=0)])
        sizes = sums[ends] - sums[starts]
        held = (sizes[:, 4] == 0) & (ends > starts)
        owner = np.repeat(np.arange(len(texts)), ends - starts)
        kept = held[owner]
        at, n = self.places(numbers[kept])
        owner, pairs, times = np.repeat(owner[kept], n), self.pairs[at], self.times[at]
        order = np.lexsort((pairs, owner))
        owner, pairs, times = owner[order], pairs[order], times[order]
        new = np.append(True, (owner[1:] != owner[:-1]) | (pairs[1:] != pairs[:-1])).nonzero()[0] if len(order) else order
        owner, pairs = owner[new], pairs[new]
        times = np.add.reduceat(times, new) if len(new) else times
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        said, listed = self.said.__getitem__, numbers.tolist()
        for i, (has, start, end, low, high) in enumerate(zip(
                held.tolist(), starts.tolist(), ends.tolist(), bounds.tolist(), bounds[1:].tolist())):
            if not has:
                yield None
                continue
            digest = hashlib.sha256(";".join(map(said, listed[start:end])).encode()).hexdigest()
            yield sizes[i, :4].tolist(), digest, pairs[low:high], times[low:high]


def stretches_of(text: str) -> list[str]:
    """The text with a space before it, cut where both tokenizers begin a token."""
    return STRETCH.split(" " + text) if text else []


def _listed(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(
        pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(_joined(arrays), kind))


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, np.int64)


def _emitted(block: int, rows: list[tuple]) -> pa.RecordBatch:
    """A block's documents, and a row with the list of its pairs and how many documents hold each."""
    pairs = [r[-2] for r in rows]
    listed, places, n = np.unique(_joined(pairs), return_inverse=True, return_counts=True)
    none, upto = np.zeros(0, np.int64), np.cumsum([0, *map(len, pairs)])
    columns = list(zip(*rows))
    last = pa.array([False] * len(rows) + [True])

    def of_block(values: np.ndarray, kind) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0] * (len(rows) + 1) + [len(values)], pa.int32()),
                                        pa.array(values, kind))
    fixed = [pa.array([*c, None], k) for c, k in zip(columns[:-2], [pa.int64()] * 5 + [pa.string()])]
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * (len(rows) + 1), pa.int64()), *fixed,
         pa.ListArray.from_arrays(pa.array([*upto, upto[-1]], pa.int32()), pa.array(places, pa.int32())),
         _listed([*columns[-1], none], pa.int32()), of_block(listed, pa.int64()), of_block(n, pa.int32()), last],
        names=[x.split()[0] for x in _ALIGNED.split(", ")])


def _aligned_batches(batches, aligner: Aligner, block: int):
    known = Stretches(aligner)
    rows, links, none = [], 0, np.zeros(0, np.int64)
    for batch in batches:
        for part in _parts(rows_of(batch, "doc_id", "text")):
            for (document, _), found in zip(part, known.whole([t for _, t in part])):
                if found is None:
                    rows.append((document, 0, 0, 0, 0, "", none, none))
                    continue
                sizes, digest, pairs, times = found
                rows.append((document, *sizes, digest, pairs, times))
                links += len(pairs)
                if links >= BLOCK:
                    yield _emitted(block, rows)
                    block, rows, links = block + 1, [], 0
    if rows:
        yield _emitted(block, rows)


def _aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per document with places in its block's list of pairs, and a row per block with that list."""
    def run(batches):
        from pyspark import TaskContext
        return _aligned_batches(batches, Aligner(path_a, path_b), TaskContext.get().partitionId() << 32)
    return texts(docs).mapInArrow(run, _ALIGNED)


def _parts(rows):
    """Rows in parts of ``BATCH`` characters, one row at least."""
    part, n = [], 0
    for row in rows:
        part.append(row)
        n += len(row[1])
        if n >= BATCH:
            yield part
            part, n = [], 0
    if part:
        yield part


def align(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): (block, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, places, times), and
    (block, place, pair, n, best): a block's pairs with the number of documents that hold them in all blocks."""
    rows = stored(_aligned(docs, path_a, path_b), "aligned")
    listed = rows.filter("of_block").select(
        "block", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "p")).select(
        "block", "place", F.col("p.pairs").alias("pair"), F.col("p.held").cast("long").alias("held"))
    totals = stored(listed.groupBy("pair").agg(F.sum("held").alias("n")), "pair-totals")
    of_a = F.shiftright("pair", 32)
    top = totals.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))
    judged = totals.join(top, of_a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return (rows.filter("NOT of_block").drop("pairs", "held", "of_block"),
            listed.drop("held").join(judged, "pair"))


def alignment_digests(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def met(documents: pa.Table, pairs: pa.Table) -> pa.Table:
        """One block: its documents look their pairs up by place."""
        n, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
        place = pairs.column("place").to_numpy()
        n[place], best[place] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy()
        best_links, counts = [], []
        for places, times in zip(documents.column("places"), documents.column("times")):
            at, often = places.values.to_numpy(), times.values.to_numpy().astype(np.int64)
            best_links.append(int((best[at] * often).sum()))
            counts.append(int((n[at] * often).sum()))
        found = {"n_best": pa.array(best_links, pa.int64()), "count_sum": pa.array(counts, pa.int64())}
        return pa.table({c: found[c] if c in found else documents.column(c) for c in names})

    documents, pairs = align(docs, path_a, path_b)
    listed = pairs.select(F.col("block").alias("of_block"), "place", "n", "best")
    return documents.groupBy("block").cogroup(listed.groupBy("of_block")).applyInArrow(
        met, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
             "groups_sha256 string")

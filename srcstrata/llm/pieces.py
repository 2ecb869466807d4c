"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

The model file gives pieces and scores. A text becomes one space mark, then the
text with spaces as marks; no piece of such a model has a mark after another
character, so merges never cross into the next mark and the text falls into
words that are encoded alone. In a word, an agenda holds candidate merges, best
score first, leftmost among equals. A candidate taken from the agenda is skipped
if a keyed hash of (seed, document, place of the word, word, place, pair) falls
below the dropout rate, so every occurrence of a word has a dropout of its own,
and the same run gives the same split wherever it is computed; the word enters
as its digest, so that long words cost no more a step. The split without dropout
and its candidates are remembered per word: an occurrence that drops none of
them has that split, the others are stepped. Without dropout, ids equal those of
the library.

:meth:`Pieces.split` is the agenda of one word. :meth:`Pieces.split_many` steps
the agendas of many words of one length together, as columns of arrays: each
round takes the best candidate of every word. Both give the same splits.

Characters without a piece become byte pieces; so does a space mark that stands
in the text itself, which the plain encoding would turn into a space. Decoding
is therefore exact for every text. Defined cases: null and empty texts have no
ids; an empty table gives an empty one; repeated rows get equal ids.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from srcstrata.llm.common import rows_of, texts

DROPOUT, SEED = 0.1, 42
MARK = "▁"
# Words with the spaces before them; a space mark in the text itself stands alone.
WORD = re.compile(f"{MARK}| *[^ {MARK}]+| +")
# Words whose splits a task keeps, characters of documents encoded together, cells of the arrays of a step,
# and the length from which a word has an agenda of its own.
REMEMBERED, BLOCK, CELLS, LONG = 1_000_000, 8_000_000, 100_000, 64
# A candidate is its pair's rank above the bits of its column, so that the smallest is the next one.
COLUMN_BITS = 6
COLUMN = np.int32(2 ** COLUMN_BITS - 1)
NONE, EMPTY = np.int32(np.iinfo(np.int32).max), np.int64(np.iinfo(np.int64).min)
# Constants of splitmix64, the mixing of the keyed hashes.
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


class Pieces:
    """Vocabulary of a model file."""

    def __init__(self, model: str):
        import sentencepiece
        loaded = sentencepiece.SentencePieceProcessor(model_file=model)
        self.piece = [loaded.id_to_piece(i) for i in range(loaded.get_piece_size())]
        special = [loaded.is_control(i) or loaded.is_unknown(i) or loaded.is_byte(i) for i in range(len(self.piece))]
        self.id = {p: i for i, p in enumerate(self.piece) if not special[i]}
        self.score = {p: loaded.get_score(i) for p, i in self.id.items()}
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if loaded.is_byte(i)}
        self.byte = {i: b for b, i in self.byte_id.items()}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id):
            raise ValueError("a piece crosses from a character into a space mark")
        self.said = [b"" if s else p.replace(MARK, " ").encode("utf-8", "surrogatepass")
                     for p, s in zip(self.piece, special)]
        for i, b in self.byte.items():
            self.said[i] = bytes([b])
        self._index_pairs()

    def _index_pairs(self) -> None:
        """Symbols (pieces, and characters that are half of one) and the pairs that merge, sorted for lookup."""
        symbol = {p: n for n, p in enumerate(self.id)}
        pairs: list[tuple[int, int, int]] = []
        hashes: list[int] = []
        for p in self.id:
            for cut in range(1, len(p)):
                first, second = p[:cut], p[cut:]
                if (first in self.id or cut == 1) and (second in self.id or cut == len(p) - 1):
                    pairs.append((symbol.setdefault(first, len(symbol)), symbol.setdefault(second, len(symbol)),
                                  symbol[p]))
                    hashes.append(_pair_hash(first, second))
        self.pair_hash = np.array(hashes, np.uint64)
        self.symbol = list(symbol)
        self.symbol_id = np.array([self.id.get(p, -1) for p in symbol], np.int64)
        _, order = np.unique([-self.score.get(p, 0.0) for p in symbol], return_inverse=True)
        first, second, self.pair_merged = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pair_rank = order.astype(np.int32)[self.pair_merged]
        # Any other character is the symbol len(symbol) + its code point; all are below 2^21.
        self.char = np.arange(0x110000, dtype=np.int64) + len(symbol)
        for p, n in symbol.items():
            if len(p) == 1:
                self.char[ord(p)] = n
        self._index_slots((first << 21) | second)

    def _index_slots(self, keys: np.ndarray) -> None:
        """A table of pairs with open addressing, eight times as large as their number."""
        bits = max(4, int(len(keys) * 8).bit_length())
        self.shift, self.last_slot = np.uint64(64 - bits), 2 ** bits - 1
        self.slot_key = np.full(2 ** bits, EMPTY)
        self.slot_pair, self.slot_rank = np.zeros(2 ** bits, np.int64), np.full(2 ** bits, NONE, np.int32)
        pending, slot = np.arange(len(keys)), self._slots(keys)
        while len(pending):
            free = self.slot_key[slot] == EMPTY
            self.slot_key[slot[free]] = keys[pending[free]]
            placed = self.slot_key[slot] == keys[pending]
            self.slot_pair[slot[placed]] = pending[placed]
            self.slot_rank[slot[placed]] = self.pair_rank[pending[placed]] << COLUMN_BITS
            pending, slot = pending[~placed], (slot[~placed] + 1) & self.last_slot

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(GOLDEN)) >> self.shift).astype(np.int64)

    def _candidates(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank above the bits of a column (``NONE`` where nothing merges) and number of pairs; symbol -1 has none."""
        wanted = (first << 21) | second
        slot = self._slots(wanted)
        found = self.slot_key[slot]
        tried = np.flatnonzero((found != wanted) & (found != EMPTY))
        while len(tried):
            slot[tried] = (slot[tried] + 1) & self.last_slot
            found[tried] = self.slot_key[slot[tried]]
            tried = tried[(found[tried] != wanted[tried]) & (found[tried] != EMPTY)]
        return np.where(found == wanted, self.slot_rank[slot], NONE), self.slot_pair[slot]

    def split(self, word: str, dropout: float = 0.0, key: int = 0) -> list[str]:
        """Pieces of one word after merges; candidates are dropped by a hash keyed with ``key``."""
        return self._split(word, int(dropout * 2 ** 64), _digest(word, key))

    def _split(self, word: str, limit: int, digest: int) -> list[str]:
        parts = list(word)
        right = list(range(1, len(parts))) + [-1]
        left = list(range(-1, len(parts) - 1))
        agenda: list[tuple[float, int, str, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0:
                score = self.score.get(parts[a] + parts[b])
                if score is not None:
                    heapq.heappush(agenda, (-score, a, parts[a], parts[b]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while agenda:
            _, a, first, second = heapq.heappop(agenda)
            b = right[a]
            if b < 0 or parts[a] != first or parts[b] != second or not first:
                continue  # one of the two has been merged meanwhile
            if limit and _mixed(digest ^ ((_pair_hash(first, second) + a * GOLDEN) & (2 ** 64 - 1))) < limit:
                continue
            parts[a], parts[b] = first + second, ""
            right[a] = right[b]
            if right[a] >= 0:
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in parts if p]

    def split_many(self, words: list[str], dropout: float = 0.0, key: int = 0) -> list[list[int]]:
        """Ids of the pieces of many words, as :meth:`split` would split each."""
        lengths, offsets, codes = _coded(words)
        digests = np.fromiter((_digest(w, key) for w in words), np.uint64, len(words))
        order, flat, counts, _ = self._split_coded(codes, offsets, lengths, digests, int(dropout * 2 ** 64))
        ends, out = np.cumsum(counts).tolist(), [[]] * len(words)
        for i, start, end in zip(order.tolist(), [0] + ends[:-1], ends):
            out[i] = flat[start:end].tolist()
        return out

    def _split_coded(self, codes: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, digests: np.ndarray | None,
                     limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Order in which words are split, the ids of all in that order, the number of ids of each, and merges.

        Words are ranges of ``codes``. Without ``limit``, the merges of words with columns are returned, as
        (words, what the dropout hash takes of the pair and its place).
        """
        order = np.argsort(lengths, kind="stable")
        flat, counts, start = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        merges: list[tuple[np.ndarray, np.ndarray]] = []
        while start < len(order):
            width = int(lengths[order[start]])
            if width > LONG:
                i = order[start]
                word = codes[offsets[i]:offsets[i] + width].tobytes().decode("utf-32-le", "surrogatepass")
                found = self.ids(self._split(word, limit, int(digests[i]) if limit else 0))
                flat.append(np.array(found, np.int32))
                counts.append(np.array([len(found)]))
                start += 1
                continue
            end = min(int(np.searchsorted(lengths, width, "right", sorter=order)), start + max(1, CELLS // (width + 1)))
            chosen = order[start:end]
            if width:
                taken: list[tuple[np.ndarray, np.ndarray]] = []
                symbols, found = self._step(codes[offsets[chosen] + np.arange(width)[:, None]],
                                            digests[chosen] if limit else None, limit, taken)
                merges += [(chosen[rows], pairs) for rows, pairs in taken]
                ids, found = self._ids_of(symbols, found)
            else:
                ids, found = np.zeros(0, np.int32), np.zeros(len(chosen), np.int64)
            flat.append(ids)
            counts.append(found)
            start = end
        return order, np.concatenate(flat), np.concatenate(counts), merges

    def _step(self, codes: np.ndarray, digests: np.ndarray | None, limit: int,
              taken: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of words of one length, a word a column of ``codes``, and the number of each word's.

        Without ``limit``, ``taken`` gets the merges of every round.

        Cells are numbered through; the row below the last character stands for no character.
        """
        width, n = codes.shape
        symbol = np.append(self.char[codes].ravel(), np.full(n, -1))
        outside = np.arange(width * n, (width + 1) * n)
        right = np.append(np.arange(n, (width + 1) * n), outside)
        left = np.append(outside, np.arange(width * n))
        best, pair = np.full((width + 1) * n, NONE, np.int32), np.zeros((width + 1) * n, np.int64)
        inner = slice(0, (width - 1) * n)
        best[inner], pair[inner] = self._candidates(symbol[inner], symbol[n:width * n])
        best[inner] |= np.repeat(np.arange(width - 1, dtype=np.int32), n)
        while True:
            top = best.reshape(width + 1, n).min(axis=0)
            rows = np.flatnonzero(top != NONE)
            if not len(rows):
                break
            column = top[rows] & COLUMN
            at = column * n + rows
            k = pair[at]
            if limit:
                dropped = _mixed_all(digests[rows] ^ self._hashed(k, column)) <= np.uint64(limit - 1)
                best[at[dropped]] = NONE
                kept = ~dropped
                column, at, k = column[kept], at[kept], k[kept]
            else:
                taken.append((rows, self._hashed(k, column)))
            gone, before, merged = right[at], left[at], self.pair_merged[k]
            after = right[gone]
            symbol[at], symbol[gone], best[gone] = merged, -1, NONE
            right[at], left[after] = after, at
            rank, pair[at] = self._candidates(merged, symbol[after])
            best[at] = rank | column
            rank, pair[before] = self._candidates(symbol[before], merged)
            best[before] = rank | (before // n).astype(np.int32)
        by_word = symbol[:width * n].reshape(width, n).T
        left_over = by_word >= 0
        return by_word[left_over], left_over.sum(axis=1)

    def _hashed(self, pair: np.ndarray, column: np.ndarray) -> np.ndarray:
        return self.pair_hash[pair] + column.astype(np.uint64) * np.uint64(GOLDEN)

    def _ids_of(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols and their number a word; a character without a piece has an id for each of its bytes."""
        inside = symbols < len(self.symbol)
        ids = np.where(inside, self.symbol_id[np.where(inside, symbols, 0)], -1).astype(np.int32)
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, counts
        spelt = [self.ids([self.symbol[s] if s < len(self.symbol) else chr(s - len(self.symbol))])
                 for s in symbols[odd].tolist()]
        times = np.ones(len(ids), np.int64)
        times[odd] = list(map(len, spelt))
        ids, ends = np.repeat(ids, times), np.append(0, np.cumsum(times))
        ids[ids < 0] = list(chain.from_iterable(spelt))
        bounds = np.append(0, np.cumsum(counts))
        return ids, np.diff(ends[bounds])

    def ids(self, pieces: Iterable[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            known = self.id.get(p)
            if known is not None:
                out.append(known)
            else:
                out.extend(self.byte_id[b] for b in p.encode("utf-8", "surrogatepass"))
        return out

    def encode(self, text: str, dropout: float = DROPOUT, seed: int = SEED, document: int = 0,
               known: Splits | None = None) -> list[int]:
        """Ids of a whole text. ``known`` remembers split words between calls."""
        return next(self.encode_many([(document, text)], dropout, seed, known)).tolist()

    def encode_many(self, rows: Iterable[tuple[int, str]], dropout: float = DROPOUT, seed: int = SEED,
                    known: Splits | None = None) -> Iterator[np.ndarray]:
        """Ids of the whole text of every (document, text), in order. ``known`` serves one dropout and seed only."""
        known = known or Splits()
        block: list[np.ndarray] = []
        places: list[np.ndarray] = []
        size = 0
        for document, text in rows:
            words = WORD.findall(" " + text) if text else []
            block.append(np.fromiter(map(known.number.__getitem__, words), np.int64, len(words)))
            if dropout:
                places.append(_places(len(words), seed, document))
            size += len(text)
            if size >= BLOCK:
                yield from self._encode_block(block, places, dropout, seed, known)
                block, places, size = [], [], 0
        yield from self._encode_block(block, places, dropout, seed, known)

    def _encode_block(self, block: list[np.ndarray], places: list[np.ndarray], dropout: float, seed: int,
                      known: Splits) -> Iterator[np.ndarray]:
        if not block:
            return
        wanted, limit = np.concatenate(block), int(dropout * 2 ** 64)
        self._remember(known, seed)
        starts, counts, flat = known.bounds[wanted], known.counts[wanted], known.flat
        if limit:
            digests = known.digests[wanted] ^ np.concatenate(places)
            again = np.flatnonzero(self._dropped(wanted, digests, limit, known))
            words = wanted[again]
            order, more, n, _ = self._split_coded(known.codes, known.offsets[words], known.lengths[words],
                                                  digests[again], limit)
            starts[again[order]] = len(flat) + np.cumsum(n) - n
            counts[again[order]] = n
            flat = np.append(flat, more)
        ends = np.append(0, np.cumsum(counts))
        ids = flat[np.repeat(starts - ends[:-1], counts) + np.arange(ends[-1])]
        if len(known.number) > REMEMBERED:
            known.clear()
        documents = ends[np.append(0, np.cumsum(list(map(len, block))))].tolist()
        for start, end in zip(documents, documents[1:]):
            yield ids[start:end]

    def _remember(self, known: Splits, seed: int) -> None:
        """Splits without dropout of the words numbered meanwhile."""
        raw = known.unknown()
        if not raw:
            return
        lengths, offsets, codes = _coded([w.replace(" ", MARK) for w in raw])
        order, flat, counts, merges = self._split_coded(codes, offsets, lengths, None, 0)
        by_word = np.empty(len(raw), np.int64)
        by_word[order] = counts
        starts = np.empty(len(raw), np.int64)
        starts[order] = np.cumsum(counts) - counts
        if MARK in raw:  # a space mark of the text itself
            said = np.array([self.byte_id[b] for b in MARK.encode()], np.int32)
            starts[raw.index(MARK)], by_word[raw.index(MARK)] = len(flat), len(said)
            flat = np.append(flat, said)
        owner = np.concatenate([m[0] for m in merges]) if merges else np.zeros(0, np.int64)
        pairs = np.concatenate([m[1] for m in merges]) if merges else np.zeros(0, np.uint64)
        digests = np.fromiter((_digest(w.replace(" ", MARK), seed) for w in raw), np.uint64, len(raw))
        known.add(starts, by_word, flat, lengths, offsets, codes, digests,
                  np.bincount(owner, minlength=len(raw)), pairs[np.argsort(owner, kind="stable")])

    def _dropped(self, wanted: np.ndarray, digests: np.ndarray, limit: int, known: Splits) -> np.ndarray:
        """Which occurrences drop a candidate of their word's plain split; long words always count as such."""
        out = known.lengths[wanted] > LONG
        at, left = known.pair_at[wanted], known.pair_n[wanted]
        rows = np.flatnonzero(left > 0)
        at, left, digests = at[rows], left[rows], digests[rows]
        while len(rows):
            gone = _mixed_all(digests ^ known.pairs[at]) <= np.uint64(limit - 1)
            out[rows[gone]] = True
            on = np.flatnonzero(~gone & (left > 1))
            rows, at, left, digests = rows[on], at[on] + 1, left[on] - 1, digests[on]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text that was encoded, whatever merges were dropped."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        return b"".join(map(self.said.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


class Splits:
    """Words numbered as they come; their characters, digests, and the ids and merges of their plain splits."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        # Per word: where its ids begin and their number, its characters, its digest, its merges.
        self.bounds, self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.lengths, self.offsets, self.codes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.digests = np.zeros(0, np.uint64)
        self.pair_at, self.pair_n, self.pairs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def unknown(self) -> list[str]:
        """The words numbered since the last call of :meth:`add`."""
        return list(islice(self.number, len(self.bounds), None))

    def add(self, starts, counts, flat, lengths, offsets, codes, digests, pair_n, pairs) -> None:
        self.bounds = np.append(self.bounds, len(self.flat) + starts)
        self.counts, self.flat = np.append(self.counts, counts), np.append(self.flat, flat)
        self.lengths = np.append(self.lengths, lengths)
        self.offsets = np.append(self.offsets, len(self.codes) + offsets)
        self.codes, self.digests = np.append(self.codes, codes), np.append(self.digests, digests)
        self.pair_at = np.append(self.pair_at, len(self.pairs) + np.cumsum(pair_n) - pair_n)
        self.pair_n, self.pairs = np.append(self.pair_n, pair_n), np.append(self.pairs, pairs)


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of words, where each begins, and the code points of all."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    return lengths, np.cumsum(lengths) - lengths, codes


def _digest(word: str, key: int) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), key)


def _pair_hash(first: str, second: str) -> int:
    return xxhash.xxh64_intdigest(f"{first}\0{second}".encode("utf-8", "surrogatepass"))


def _mixed(z: int) -> int:
    z = ((z ^ (z >> 30)) * MIX_1) & (2 ** 64 - 1)
    z = ((z ^ (z >> 27)) * MIX_2) & (2 ** 64 - 1)
    return z ^ (z >> 31)


def _mixed_all(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
    return z ^ (z >> np.uint64(31))


def _places(n: int, seed: int, document: int) -> np.ndarray:
    """Keyed hash of every word's place."""
    start = xxhash.xxh64_intdigest(f"{seed}:{document}".encode())
    return _mixed_all(np.arange(n, dtype=np.uint64) * np.uint64(GOLDEN) + np.uint64(start))


def encode(docs: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, text, ids) of every row of ``docs(doc_id, text)``."""
    def run(batches):
        pieces, known = Pieces(model), Splits()
        for batch in batches:
            ids = list(pieces.encode_many(((-1 if d is None else d, t) for d, t in rows_of(batch, "doc_id", "text")),
                                          dropout, seed, known))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(ids, pa.list_(pa.int32()))],
                names=["doc_id", "text", "ids"])
    return texts(docs).mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded(doc_id, ids)`` with the decoded text."""
    def run(batches):
        pieces = Pieces(model)
        for batch in batches:
            said = [pieces.decode(i or ()) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(said, pa.string())],
                                             names=["doc_id", "ids", "decoded"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def ids_crc32(ids: Iterable[int]) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit numbers."""
    ids = ids if isinstance(ids, np.ndarray) else list(ids)
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def encoding_digests(docs: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, lossless) of every row: each text is encoded and decoded again."""
    def run(batches):
        pieces, known = Pieces(model), Splits()
        for batch in batches:
            keyed = list(rows_of(batch, "doc_id", "text"))
            encoded = pieces.encode_many(((-1 if d is None else d, t) for d, t in keyed), dropout, seed, known)
            rows = [(d, len(ids), ids_crc32(ids), pieces.decode(ids) == t) for (d, t), ids in zip(keyed, encoded)]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))],
                names=["doc_id", "n_ids", "ids_crc32", "lossless"])
    return texts(docs).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, lossless boolean")

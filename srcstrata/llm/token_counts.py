"""Token counts of whole texts by a byte-level BPE vocabulary file, most pre-tokens without a merge.

Before any text is read it is proven once, on the driver, which strings of the
vocabulary encode alone as one token: the splitting pattern leaves the string
whole, and replaying the merges on its bytes ends in that very token
(:func:`proven`, a set bounded by the vocabulary). A pre-token of a text that is
in this set counts as one without being merged; only the others are merged, by
the library's own merge table. A text is cut at single spaces between two other
characters, where a pre-token always begins, and the count of such a stretch is
remembered, ``REMEMBERED`` of them at most in a task, so texts never leave their
task and nothing is shuffled.

The file's added tokens are found in texts as its tokenizer finds them by
default, one token each, and what stands between them is counted alone.

Defined cases: null and empty text have 0 bytes and 0 tokens; repeated rows, null
ids and ties are rows of their own; a text of any length is counted whole; other
columns of the table are not read, whatever their names; an empty table gives an
empty one.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcstrata.llm.common import rows_of, texts
from srcstrata.llm.packing import PATTERN, byte_characters

LIMIT, REMEMBERED, LONGEST = 1024, 300_000, 100

# A space that ends one stretch of a text and begins the next.
STRETCH = re.compile(r"(?<=\S)(?= \S)")


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The symbols after all merges, the lowest rank first, the leftmost of equal ones."""
    left, right = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
    said: list[str | None] = list(symbols)
    agenda = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
    heapify(agenda)
    while agenda:
        rank, i = heappop(agenda)
        j = right[i]
        if said[i] is None or j < 0 or ranks.get((said[i], said[j])) != rank:
            continue  # one of the two was merged before
        said[i], said[j] = said[i] + said[j], None
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for k in (left[i], i):
            if k >= 0 and right[k] >= 0:
                r = ranks.get((said[k], said[right[k]]))
                if r is not None:
                    heappush(agenda, (r, k))
    return [s for s in said if s is not None]


def _loaded(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        loaded = json.load(f)
    model, before = loaded["model"], loaded["pre_tokenizer"] or {}
    if (model["type"], before.get("type"), before.get("use_regex"), before.get("add_prefix_space")) != (
            "BPE", "ByteLevel", True, False) or loaded["normalizer"] or model.get("dropout") or model.get(
            "continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        raise ValueError(f"not a plain byte-level BPE: {path}")
    if any(t.get(k) for t in loaded["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("an added token takes more or less than its own characters")
    return loaded


def proven(path: str) -> frozenset[str]:
    """The strings of the vocabulary that encode alone as one token."""
    model, byte_of, pattern = _loaded(path)["model"], byte_characters(), regex.compile(PATTERN)
    pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
    ranks = {p: i for i, p in enumerate(pairs)}
    found = set()
    for token in model["vocab"]:
        try:
            said = bytes(byte_of[c] for c in token).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue  # parts of characters are no pre-tokens
        if pattern.findall(said) == [said] and merged(list(token), ranks) == [token]:
            found.add(said)
    return frozenset(found)


class Counts(dict):
    """Tokens of a stretch of text, remembered."""

    def __init__(self, path: str, whole: frozenset[str]):
        from tokenizers import Tokenizer
        self.whole, self.model = whole, Tokenizer.from_file(path).model
        self.findall = regex.compile(PATTERN).findall
        self.shown = {b: c for c, b in byte_characters().items()}
        added = sorted((t["content"] for t in _loaded(path)["added_tokens"]), key=len, reverse=True)
        self.added, self.between = added, re.compile("(" + "|".join(map(re.escape, added)) + ")")

    def __missing__(self, stretch: str) -> int:
        n = 0
        for word in self.findall(stretch):
            n += 1 if word in self.whole else len(
                self.model.tokenize(word.encode().decode("latin-1").translate(self.shown)))
        if len(stretch) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[stretch] = n
        return n

    def of(self, text: str) -> int:
        if not any(token in text for token in self.added):
            return sum(map(self.__getitem__, STRETCH.split(text)))
        parts = self.between.split(text)  # every second part is an added token
        return len(parts) // 2 + sum(sum(map(self.__getitem__, STRETCH.split(p))) for p in parts[::2])


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs(doc_id, text)``."""
    whole = docs.sparkSession.sparkContext.broadcast(proven(path))

    def run(batches):
        counts = Counts(path, whole.value)
        for batch in batches:
            rows = [(d, len(t.encode()), counts.of(t)) for d, t in rows_of(batch, "doc_id", "text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)],
                names=["doc_id", "n_bytes", "n_tokens"])

    counted = texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

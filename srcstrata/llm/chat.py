"""Chat formatting by schema fingerprints.

Records arrive as JSON objects of any layout. The sorted set of a record's
nested field paths is hashed; the hash picks a declarative mapping, which says
where turns, roles and texts are. A record without a mapping is not dropped: it
comes out as one row that names its fingerprint and the problem.

Turns are written as ``<|im_start|>role\\ntext<|im_end|>\\n``, one row per turn,
so that a conversation of any length is never held in one place; its formatted
text is its rows' segments in order. Control strings inside texts and roles get
one backslash after their first character, and strings that already have
backslashes there get one more, which makes the step reversible.

Defined cases: null role and null text are empty; a null conversation id is one
conversation; turns with equal numbers are ordered by position in their record,
role and text; null turn numbers come first; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcstrata.llm.common import rows_of


@dataclass(frozen=True)
class Part:
    """Turns at one place of a record. ``[]`` in a path steps into a list.

    ``text`` lists the paths whose non-empty values, joined by a line break,
    are the text. The role is read at ``role`` or, without it, is ``said_by``.
    """

    text: tuple[str, ...]
    role: str | None = None
    said_by: str = ""


@dataclass(frozen=True)
class Mapping:
    """A layout: all ``required`` paths and any of the ``optional`` ones."""

    name: str
    required: frozenset[str]
    parts: tuple[Part, ...]
    conversation: str = "conv_id"
    order: str | None = None
    optional: frozenset[str] = frozenset()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def fingerprints(self) -> Iterator[str]:
        for n in range(len(self.optional) + 1):
            for extra in itertools.combinations(sorted(self.optional), n):
                yield fingerprint(self.required.union(extra))


SHARED_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping("message rows", frozenset({"conv_id", "turn", "role", "text"}),
            (Part(("text",), role="role"),), order="turn"),
    Mapping("messages", frozenset({"conv_id", "messages[].role", "messages[].content"}),
            (Part(("messages[].content",), role="messages[].role"),), optional=frozenset({"source", "lang"})),
    Mapping("shared turns", frozenset({"conv_id", "conversations[].from", "conversations[].value"}),
            (Part(("conversations[].value",), role="conversations[].from"),), roles=SHARED_ROLES),
    Mapping("instruction", frozenset({"conv_id", "instruction", "output"}),
            (Part(("system",), said_by="system"), Part(("instruction", "input"), said_by="user"),
             Part(("output",), said_by="assistant")), optional=frozenset({"input", "system"})),
    Mapping("prompt and response", frozenset({"conv_id", "prompt", "response"}),
            (Part(("prompt",), said_by="user"), Part(("response",), said_by="assistant"))),
    Mapping("prompt and completion", frozenset({"conv_id", "prompt", "completion"}),
            (Part(("prompt",), said_by="user"), Part(("completion",), said_by="assistant"))),
)


def _name(field: str) -> str:
    """A field's name in a path, with the signs of paths escaped: ``a.b`` is one field and no field in another."""
    return re.sub(r"[\\.\[\]\n]", lambda m: "\\n" if m[0] == "\n" else "\\" + m[0], field)


def paths(value, at: str = "") -> set[str]:
    """Field paths of a parsed JSON value; list positions do not count."""
    if isinstance(value, dict) and value:
        return set().union(*(paths(v, f"{at}.{_name(k)}" if at else _name(k)) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(found: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def values(value, path: str) -> list:
    """All values at a path, in order; absent fields give nothing."""
    found = [value]
    for step in re.findall(r"\[\]|[^.\[\]]+", path):
        if step == "[]":
            found = [x for v in found if isinstance(v, list) for x in v]
        else:
            found = [v[step] if isinstance(v, dict) and step in v else None for v in found]
    return found


def _string(value) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, mapping: Mapping) -> Iterator[tuple[str, str]]:
    """(role, text) pairs of one record."""
    for part in mapping.parts:
        columns = [values(record, p) for p in part.text]
        given = values(record, part.role) if part.role else None
        for i, several in enumerate(zip(*columns)):
            if part.role is None and all(v is None for v in several) and len(mapping.parts) > 1 and \
                    not set(part.text) & mapping.required:
                continue  # an optional part that the record does not have
            text = "\n".join(t for t in map(_string, several) if t)
            role = _string(given[i]) if given is not None else part.said_by
            yield mapping.roles.get(role, role), text


TURNS = ("conversation string, turn long, place long, role string, text string, "
         "layout string, fingerprint string, problem string")
TURNS_ARROW = pa.schema([(n, pa.string() if k == "string" else pa.int64())
                         for n, k in (x.split() for x in TURNS.split(", "))])


def canonical_turns(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """One row per turn of every JSON record, plus one row per record without a mapping."""
    chosen = {p: m for m in mappings for p in m.fingerprints()}

    def convert(batches):
        for batch in batches:
            out = []
            for (text,) in rows_of(batch, "record"):
                try:
                    parsed = json.loads(text or "null", strict=False)
                except ValueError:
                    out.append((None, None, None, None, None, None, None, "not JSON"))
                    continue
                shape = fingerprint(paths(parsed))
                mapping = chosen.get(shape)
                if mapping is None:
                    out.append((None, None, None, None, None, None, shape, "no mapping"))
                    continue
                conversation = values(parsed, mapping.conversation)[0]
                turn = values(parsed, mapping.order)[0] if mapping.order else None
                turn = int(turn) if isinstance(turn, (int, float)) else None
                key = None if conversation is None else _string(conversation)
                out += [(key, i if mapping.order is None else turn, i, role, said, mapping.name, shape, None)
                        for i, (role, said) in enumerate(turns_of(parsed, mapping))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
                zip(*out) if out else [[]] * len(TURNS_ARROW), TURNS_ARROW)], schema=TURNS_ARROW)

    return records.select(F.col(record).cast("string").alias("record")).mapInArrow(convert, TURNS)


# Control strings that a text may not spell out in the formatted output.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END = CONTROL[:2]
_REST = "|".join(re.escape(c[1:]) for c in CONTROL)
ESCAPE = (rf"([<\[])(\\*)({_REST})", r"$1\\$2$3")
UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_REST})")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE[0]), F.lit(ESCAPE[1]))


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def format_turns(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """Segments of the formatted text, with the loss mask as a span of code points in the segment.

    Returns the turns' own columns plus ``segment``, ``loss_start`` and
    ``loss_length`` (0 where the role is not ``learned``).
    """
    role = F.regexp_replace(F.regexp_replace(F.coalesce("role", F.lit("")), r"\\", r"\\\\"), "\n", r"\\n")
    text = escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), escaped(role), F.lit("\n"))
    return (turns.withColumn("__head", head).withColumn("__said", text)
            .withColumn("segment", F.concat("__head", "__said", F.lit(END + "\n")))
            .withColumn("loss_start", F.length("__head").cast("long"))
            .withColumn("loss_length", F.when(F.col("role") == learned, F.length("__said")).otherwise(0).cast("long"))
            .drop("__head", "__said"))


SEGMENT = re.compile(rf"{re.escape(START)}([^\n]*)\n(.*){re.escape(END)}\n", re.DOTALL)
ROLE_ESCAPES = re.compile(r"\\(.)")


def read_segment(segment: str) -> tuple[str, str]:
    """Role and text, unescaped, of one formatted turn."""
    found = SEGMENT.fullmatch(segment)
    role = ROLE_ESCAPES.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(found[1]))
    return role, unescape(found[2])


DIGESTS = ("conversation string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")


def digests(formatted: DataFrame) -> DataFrame:
    """Hashes of every conversation, read back from its segments.

    Rows are sorted in their partition and streamed, so one conversation may
    hold any share of all rows without being gathered.
    """
    schema = pa.schema([(n, pa.string() if k == "string" else pa.int64())
                        for n, k in (x.split() for x in DIGESTS.split(", "))])

    def fold(batches):
        key = state = None
        for batch in batches:
            done = []
            for conversation, segment, start, length in rows_of(
                    batch, "conversation", "segment", "loss_start", "loss_length"):
                if state is None or conversation != key:
                    if state is not None:
                        done.append(_row(key, state))
                    key, state = conversation, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_segment(segment)
                learned = unescape(segment[start:start + length])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(segment)
            yield _batch(done, schema)
        if state is not None:
            yield _batch([_row(key, state)], schema)

    return (formatted.select("conversation", "turn", "place", "role", "text", "segment", "loss_start", "loss_length")
            .repartition("conversation")
            .sortWithinPartitions("conversation", "turn", "place", "role", "text")
            .select("conversation", "segment", "loss_start", "loss_length")
            .mapInArrow(fold, DIGESTS))


def _row(key, state) -> tuple:
    n, turns, chars, loss, total = state
    return key, n, turns.hexdigest(), chars, loss.hexdigest(), total


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

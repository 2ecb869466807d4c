"""Spelling variants: words one edit apart, by composing finite-state machines.

The vocabulary is cut into partitions by initial states: words that share a
first part start in the state that this part leads to, words that share a last
part in that of the reversed acceptor. For a shorter word of ``m`` code points
the parts are the first ``m // 2`` and the last ``m - m // 2``: one edit leaves one of
them whole. Partitions are sorted streams, so a task holds one at a time, and
the parts grow with the words, so a partition has at most alphabet ** (m - m // 2 + 1)
words, however large the vocabulary.

In a partition the rests of the words become two minimised acceptors, of the
words with ``m`` code points and with ``m + 1`` (:class:`Acceptor`). Their
composition with the one-edit transducer is walked from the initial pair of
states (:func:`near_pairs`): equal arcs, then one replacement or insertion, then
equal arcs to the end, dead pairs of states remembered. An edit may come only
where the words first differ, so a pair has one path; a pair whose first parts
are equal belongs to the forward partition alone. Accepted paths carry the
words' numbers in order, not their letters. No words are compared pair by pair.

Counts of near words and the best one are summed per word before they meet, and
roots are found by pointer doubling over stored tables: a form has at least
twice the count, so chains end.

Defined cases: null and empty texts have no words; a null id hashes as an empty
one; repeated rows count as often as they stand there; of near words with equal
counts the smallest in code-point order is the form; very long runs are words
like others; other columns are not read, whatever their names; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcstrata.llm.common import lower_ascii, rows_of, texts
from srcstrata.session import stored

LEAST_LENGTH, LEAST_COUNT, ONE_IN, FACTOR = 5, 3, 97, 2

# Fixed value: the letters of a run after lower-casing.
RUN = "[a-zÀ-ÿ]+"


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
               one_in: int = ONE_IN) -> DataFrame:
    """(word, n): runs of letters, one in ``one_in`` of them without one letter, that are long and frequent enough."""
    runs = texts(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(
        F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    word = F.when(F.col("h") % one_in == 0, F.concat(
        F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))).otherwise(
        F.col("run"))
    # Runs only get shorter, so those too short already are not hashed.
    return (runs.filter(F.char_length("run") >= least_length).withColumn("h", h).select(word.alias("word"))
            .filter(F.char_length("word") >= least_length)
            .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count))


class Acceptor:
    """Minimised acceptor of sorted distinct words, built word by word (Daciuk et al. 2000).

    Words are numbered in their order: ``before`` of an arc is the number of
    words that go by smaller arcs of its state.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        known: dict[tuple, int] = {}
        path, last = [0], ""  # states along the last word, not yet minimised
        free: list[int] = []
        for word in [*words, None]:
            same = 0
            if word is not None:
                top = min(len(word), len(last))
                while same < top and word[same] == last[same]:
                    same += 1
            for i in range(len(last), same, -1):  # the rest of the last word is complete
                state = path.pop()
                key = (self.final[state], *self.arcs[state].items())
                equal = known.setdefault(key, state)
                if equal != state:
                    self.arcs[path[-1]][last[i - 1]] = equal
                    self.arcs[state] = {}
                    free.append(state)
            if word is None:
                break
            for c in word[same:]:
                state = free.pop() if free else len(self.arcs)
                if state == len(self.arcs):
                    self.arcs.append({})
                    self.final.append(False)
                self.final[state] = False
                self.arcs[path[-1]][c] = state
                path.append(state)
            self.final[path[-1]] = True
            last = word
        self._number()

    def _number(self) -> None:
        """Words accepted from every state, and before every arc."""
        self.words: dict[int, int] = {}
        self.before: dict[int, dict[str, int]] = {}
        todo = [0]
        while todo:
            state = todo[-1]
            later = [t for t in self.arcs[state].values() if t not in self.words]
            if later:
                todo += later
                continue
            todo.pop()
            if state in self.words:
                continue
            n, self.before[state] = int(self.final[state]), {}
            for c, t in self.arcs[state].items():  # in the order of the words
                self.before[state][c] = n
                n += self.words[t]
            self.words[state] = n


def _equal_rests(a: Acceptor, b: Acceptor, p: int, q: int, dead: set[tuple[int, int]], inserted: str | None
                 ) -> Iterator[tuple[int, int]]:
    """Numbers, from p and from q, of words that both accept; the first arc is not ``inserted``."""
    stack = [(p, q, 0, 0, inserted, False)]
    accepted = 0
    marks: list[int] = []
    while stack:
        p, q, i, j, banned, leaving = stack.pop()
        if leaving:
            if accepted == marks.pop():
                dead.add((p, q))
            continue
        if (p, q) in dead:
            continue
        if a.final[p] and b.final[q]:
            accepted += 1
            yield i, j
        if banned is None:
            marks.append(accepted - (a.final[p] and b.final[q]))
            stack.append((p, q, 0, 0, None, True))
        of_a, of_b = a.arcs[p], b.arcs[q]
        for c in of_a if len(of_a) <= len(of_b) else of_b:
            if c != banned and c in of_a and c in of_b:
                stack.append((of_a[c], of_b[c], i + a.before[p][c], j + b.before[q][c], None, False))


def near_pairs(short: Acceptor, long: Acceptor) -> Iterator[tuple[int, int, bool]]:
    """(number in ``short``, number, inserted) of all words one edit apart: replaced, both numbers in ``short`` and in
    order, or inserted, the second in ``long``. Rests are of one length in each acceptor."""
    dead: set[tuple[int, int]] = set()
    stack = [(0, 0, 0)]  # replacement: both in one state
    while stack:
        p, i, j = stack.pop()
        arcs = list(short.arcs[p].items())
        for k, (c, s) in enumerate(arcs):
            for d, t in arcs[k + 1:]:
                for x, y in _equal_rests(short, short, s, t, dead, None):
                    yield i + short.before[p][c] + x, j + short.before[p][d] + y, False
        for c, s in arcs:
            if short.words[s] > 1:
                stack.append((s, i + short.before[p][c], j + short.before[p][c]))
    dead, stack = set(), [(0, 0, 0, 0)]  # insertion: the longer word takes one arc more
    while stack:
        p, q, i, j = stack.pop()
        for c, t in long.arcs[q].items():
            for x, y in _equal_rests(short, long, p, t, dead, c):
                yield i + x, j + long.before[q][c] + y, True
        for c, s in short.arcs[p].items():
            if c in long.arcs[q]:
                stack.append((s, long.arcs[q][c], i + short.before[p][c], j + long.before[q][c]))


def _of_partition(key: tuple, rows: list[tuple[str, int]]):
    """(word, n_near, form_n, form) of a partition's words that have near words in it."""
    m, backward, part = key
    half = m // 2
    turned = sorted((w[::-1] if backward else w, n) for w, n in rows)
    skip = len(part)
    words = [[(w, n) for w, n in turned if len(w) == length] for length in (m, m + 1)]
    short, long = (Acceptor([w[skip:] for w, _ in some]) for some in words)
    found: dict[str, tuple[int, int, str]] = {}
    for i, j, inserted in near_pairs(short, long):
        (v, n), (w, k) = words[0][i], words[inserted][j]
        if backward:
            v, w = v[::-1], w[::-1]
            if v[:half] == w[:half]:
                continue  # a pair of the forward partition
        for x, y, ny in ((v, w, k), (w, v, n)):
            near, best, form = found.get(x, (0, 0, ""))
            if ny > best or ny == best and y < form:
                best, form = ny, y
            found[x] = near + 1, best, form
    return [(x, *said) for x, said in found.items()]


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n_near, form_n, form): number of near words and the one of largest count, for words that have any."""
    length = F.char_length("word")
    sides = []
    for less in (0, 1):  # as the shorter or the longer word of a pair
        m = length - less
        half = F.floor(m / 2).cast("int")
        for backward in (False, True):
            part = F.reverse(F.expr("word")).substr(F.lit(1), m - half) if backward else F.col("word").substr(
                F.lit(1), half)
            sides.append(F.when(m >= least_length, F.struct(
                m.alias("m"), F.lit(backward).alias("backward"), part.alias("part"))))
    keyed = words.select("word", "n", F.explode(F.array_compact(F.array(*sides))).alias("k")).select("k.*", "word", "n")

    def run(batches):
        def emit(out):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                names=["word", "n_near", "form_n", "form"])
        key, rows, out = None, [], []
        for batch in batches:
            for m, backward, part, word, n in rows_of(batch, "m", "backward", "part", "word", "n"):
                if (m, backward, part) != key:
                    if len(rows) > 1:
                        out += _of_partition(key, rows)
                    key, rows = (m, backward, part), []
                    if len(out) >= 10_000:
                        yield emit(out)
                        out = []
                rows.append((word, n))
        if len(rows) > 1:
            out += _of_partition(key, rows)
        if out:
            yield emit(out)

    parts = (keyed.repartition("m", "backward", "part").sortWithinPartitions("m", "backward", "part")
             .mapInArrow(run, "word string, n_near long, form_n long, form string"))
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """``forms(word, form)`` with the last form each leads to, by pointer doubling; chains must end."""
    led = stored(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        steps = led.filter("root <> word").select(F.col("word").alias("at"), F.col("root").alias("onward"))
        led_on = stored(led.join(steps, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        led = led_on.drop("moved")
        if led_on.filter("moved").isEmpty():
            return led


def spelling_variants(docs: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary of ``docs(doc_id, text)``."""
    words = stored(vocabulary(docs), "vocabulary")
    near = near_words(words).withColumnRenamed("word", "near_word")
    enough = F.col("form_n") >= factor * F.col("n")
    formed = stored(words.join(near, F.col("word") == F.col("near_word"), "left").select(
        "word", F.when(enough, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("form_n")).alias("form_n")), "forms")
    led = roots(formed).select(F.col("word").alias("led_word"), "root")
    return formed.join(led, F.col("word") == F.col("led_word")).select(
        "word", "form", "root", "n", "n_near", "form_n")

"""Exact, SimHash, substring and line dedup against plain versions."""

import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm_fixtures import awkward, documents, prose

from srcstrata.llm import exact, lines, simhash, substrings

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return (text or "").encode().split()


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


# exact

def plain_exact(given):
    groups = defaultdict(list)
    for i, t in given:
        groups[(t or "").translate(UPPER)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, digest) for i in ids]
    return sorted(out, key=repr)


def test_exact_groups(spark):
    assert rows(exact.duplicate_groups(documents(spark, awkward()))) == plain_exact(awkward())


def test_exact_keeps_one_row_per_text_and_all_columns(spark):
    docs = documents(spark, awkward())
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns
    found = sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr)
    expected = sorted({(k, t) for _, k, _, _, t in plain_exact(awkward())}, key=repr)
    assert sorted([(i, hashlib.sha256((t or "").translate(UPPER).encode()).hexdigest()) for i, t in found],
                  key=repr) == expected


def test_exact_of_nothing(spark):
    assert exact.duplicate_groups(documents(spark, [])).count() == 0
    assert exact.deduplicate(documents(spark, [])).count() == 0


# SimHash

def plain_simhash(text, shingle=3):
    w = (text or "").translate(UPPER).encode().split()
    grams = [b" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] or ([b" ".join(w)] if w else [])
    bits = Counter(b for g in grams for h in [xxhash.xxh64_intdigest(g, 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


def plain_components(prints, k=3):
    """Component of every position by comparing all pairs."""
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= k:
                parent[top(i)] = top(j)
    return [top(i) for i in range(len(prints))]


def test_simhash_of_awkward_documents(spark):
    given = awkward()
    prints = [plain_simhash(t) for _, t in given]
    roots = plain_components(prints)
    smallest = {r: min((i for (i, _), q in zip(given, roots) if q == r and i is not None), default=None)
                for r in roots}
    expected = sorted([(i, f"{p:016x}", smallest[r]) for (i, _), p, r in zip(given, prints, roots)], key=repr)
    assert rows(simhash.near_duplicates(documents(spark, given))) == expected


def test_simhash_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    given = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [plain_simhash(t) for _, t in given]
    roots = plain_components(prints)
    smallest = {r: min(i for (i, _), q in zip(given, roots) if q == r) for r in roots}
    expected = sorted([(i, f"{p:016x}", smallest[r]) for (i, _), p, r in zip(given, prints, roots)], key=repr)
    assert rows(simhash.near_duplicates(docs)) == expected
    assert len(set(smallest.values())) < len(given)


@pytest.mark.parametrize("wide", [4096, 3])
def test_links_connect_what_all_pairs_connect(spark, wide):
    draw = random.Random(7)
    prints = set()
    for _ in range(40):
        seed = draw.getrandbits(64)
        for _ in range(draw.randrange(1, 12)):
            prints.add(seed)
            for _ in range(draw.randrange(1, 4)):
                seed ^= 1 << draw.randrange(64)
    half = draw.getrandbits(32)  # many fingerprints with one half in common
    prints |= {half << 32 | draw.getrandbits(6) << draw.choice((0, 13, 26)) for _ in range(150)}
    prints = sorted(prints)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long").repartition(4), wide=wide).collect()
    place = {p: i for i, p in enumerate(signed)}
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in found:
        assert (prints[place[a]] ^ prints[place[b]]).bit_count() <= 3
        parent[top(place[a])] = top(place[b])
    expected = plain_components(prints)
    pairs = set(zip(expected, map(top, range(len(prints)))))
    assert len(pairs) == len(set(expected)) == len({b for _, b in pairs})


def test_simhash_keeps_one_of_each_component(spark):
    given = awkward()
    verdict = {}
    for i, _, c in simhash.near_duplicates(documents(spark, given)).collect():
        verdict.setdefault(i, []).append(i == c)
    docs = documents(spark, given)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    expected = [i for i, _ in given if i is None or any(verdict[i])]
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted(expected, key=repr)
    assert simhash.deduplicate(documents(spark, [])).count() == 0


# substrings

def plain_substrings(given, window):
    texts = [words(t) for _, t in given]
    count = Counter(tuple(w[s:s + window]) for w in texts for s in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(given, texts):
        gone = {p for s in range(len(w) - window + 1) if count[tuple(w[s:s + window])] > 1
                for p in range(s, s + window)}
        out.append((i, len(w), len(gone), bytearray(b" ".join(x for p, x in enumerate(w) if p not in gone))))
    return sorted(out, key=repr)


def test_substrings_of_awkward_documents(spark):
    assert rows(substrings.remove_repeated(documents(spark, awkward()))) == plain_substrings(awkward(), 35)


@pytest.mark.parametrize("seed", range(3))
def test_substrings_with_few_words_and_short_windows(spark, seed):
    """Periods, overlaps, passages with every kind of end, a passage in most documents."""
    draw = random.Random(seed)
    shared = [prose(draw.randrange(6, 30), 100 + seed * 10 + k, 50) for k in range(4)]
    given = [(i, " ".join(draw.choice([prose(draw.randrange(0, 20), draw.random(), 30), draw.choice(shared),
                                       " ".join(draw.choice(shared).split()[draw.randrange(3):draw.randrange(4, 20)]),
                                       "a b " * draw.randrange(9)])
                          for _ in range(draw.randrange(5)))) for i in range(60)]
    found = rows(substrings.remove_repeated(documents(spark, given), window=9, gram=3))
    assert found == plain_substrings(given, 9)
    assert sum(r[2] for r in found) > 0


class Given:
    """Stands for a frame: hands back the function that a step runs over its batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("step", [lambda: substrings._anchors(Given(), 35, 8), lambda: substrings._windows(Given(), 35),
                                  lambda: substrings._removed(Given(), 35)], ids=["anchors", "windows", "removed"])
def test_steps_hold_few_texts_of_a_batch_as_objects(step):
    n, texts = 4000, [prose(700, seed) for seed in range(40)]
    batch = pa.RecordBatch.from_pylist([
        {"doc_id": i, "hash": i, "text": texts[i % 40], "ranges": [{"anchor": 1, "first": 5, "windows": 9}]}
        for i in range(n)])
    run = step()
    tracemalloc.start()
    found = sum(part.num_rows for part in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found >= n
    assert most < 16 * 2 ** 20, most / 2 ** 20


def test_phrases_of_more_words_than_letters_are_found_alike(monkeypatch):
    draw = random.Random(5)
    texts = [" ".join(draw.choice(["a b", "c d e", "f"]) for _ in range(60)).encode() for _ in range(20)]
    spans = [[(0, 9), (20, 31)] if i % 2 else [] for i in range(20)]
    strings = [(w, m.tolist()) for w, m in substrings.located(texts, spans)]
    monkeypatch.setattr(substrings, "LETTERS", 10)
    assert [(w, m.tolist()) for w, m in substrings.located(texts, spans)] == strings
    assert any(any(m) for _, m in strings)


def test_substrings_of_nothing(spark):
    assert substrings.remove_repeated(documents(spark, [])).count() == 0


# lines

def plain_lines(given, width):
    seen, out = set(), {}
    for i, t in sorted(set(given), key=lambda x: (x[0] is not None, x[0] or 0)):
        all_lines = (t or "").split("\n")
        at = [k for k, x in enumerate(all_lines) if x.encode().strip()]
        gone = set()
        for s in range(len(at) - width + 1):
            key = tuple(all_lines[k] for k in at[s:s + width])
            if key in seen:
                gone |= set(at[s:s + width])
            seen.add(key)
        out[i, t] = (i, len(at), len(gone), "\n".join(x for k, x in enumerate(all_lines) if k not in gone))
    return sorted([out[x] for x in given], key=repr)


@pytest.mark.parametrize("width", [1, 2, 3, 5])
def test_lines(spark, width):
    draw = random.Random(width)
    given = [(i, "\n".join(draw.choice("aaabcdefgh ") for _ in range(draw.randrange(30)))) for i in range(40)]
    given += [(50, None), (51, ""), (52, given[3][1]), (None, given[3][1]), (53, "\n".join("abc" * 300))]
    given += [(54, "q\nr\ns\nt\nu\nv"), (54, "q\nr\ns\nt\nu\nv")]
    assert rows(lines.deleted_runs(documents(spark, given), width)) == plain_lines(given, width)


def test_runs_are_maximal(spark):
    given = [(1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\ny\nd\ne\nz")]
    found = lines.repeated_runs(documents(spark, given)).select("doc_id", "start", "end")
    assert rows(found) == [(2, 1, 4), (2, 5, 7)]


def lines_by_common_prefixes(given, least):
    """Lines of the longest prefix that a suffix shares with any earlier suffix, whatever its depth."""
    documents_, out = {}, []
    for i, t in given:
        documents_.setdefault((i is not None, i or 0), [x for x in (t or "").split("\n") if x.strip()])
    suffixes = [(key, s) for key in sorted(documents_) for s in range(len(documents_[key]))]
    gone = set()
    for n, (key, s) in enumerate(suffixes):
        mine, depth = documents_[key], 0
        for other, r in suffixes[:n]:
            theirs, k = documents_[other], 0
            while s + k < len(mine) and r + k < len(theirs) and mine[s + k] == theirs[r + k]:
                k += 1
            depth = max(depth, k)
        if depth >= least:
            gone |= {(key, s + k) for k in range(depth)}
    for i, t in given:
        key = (i is not None, i or 0)
        out.append((i, len(documents_[key]), sum(k == key for k, _ in gone),
                    "\n".join(x for k, x in enumerate(documents_[key]) if (key, k) not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_longest_common_prefixes_delete_the_same_lines(spark, least):
    draw = random.Random(20 + least)
    given = [(i, "\n".join(draw.choice("aabcdefg") for _ in range(draw.randrange(1, 25)))) for i in range(12)]
    given += [(20, given[3][1] + "\nz\n" + given[4][1]), (None, given[5][1])]
    assert rows(lines.deleted_runs(documents(spark, given), least)) == lines_by_common_prefixes(given, least)


def test_lines_of_nothing(spark):
    assert lines.deleted_runs(documents(spark, [])).count() == 0

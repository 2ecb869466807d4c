"""Token counts, tokenizer alignment and spelling variants against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given as drawn
from hypothesis import settings
from hypothesis import strategies as st
from llm_fixtures import awkward, documents, prose
from tokenizers import Tokenizer

from srcstrata.llm import alignment, queries, spelling, token_counts

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "<s> </s> hi", "<0x41>", "\x00a", "a\t b \n c", " a", "a ", "  ",
       "中文字符 测试 😀😀 x", "ﬁ ǅ", "a\x1cb \x1c c", "é   x\n\n y", "it's we'll 12 345,6", "x" * 50_000, "a\u0085 b",
       "a  b 　c", "▁", "a ▁b"]


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def table_texts():
    import pyarrow.parquet as pq
    return pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()


def mixed():
    return awkward() + [(100 + i, t) for i, t in enumerate(ODD)]


# token counts

def test_proven_strings_are_those_that_encode_alone():
    library, found = Tokenizer.from_file(BYTES), token_counts.proven(BYTES)
    byte_of = token_counts.byte_characters()
    said = []
    for token in library.get_vocab(False):
        try:
            said.append(bytes(byte_of[c] for c in token).decode())
        except UnicodeDecodeError:
            continue
    alone = {s for s, e in zip(said, library.encode_batch(said, add_special_tokens=False)) if len(e.ids) == 1}
    assert found == alone
    assert len(found) > 49_000


def test_counts_are_the_librarys(spark):
    library = Tokenizer.from_file(BYTES)
    given = mixed() + [(r["doc_id"], r["text"]) for r in table_texts()]
    expected = []
    for i, text in given:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected.append((i, len((text or "").encode()), n, n > 1024))
    assert rows(token_counts.token_counts(documents(spark, given), BYTES)) == sorted(expected, key=repr)


def test_every_character_is_split_as_the_library_splits_it():
    library, counts = Tokenizer.from_file(BYTES), token_counts.Counts(BYTES, token_counts.proven(BYTES))
    points = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    texts = [f"a{c} {c}1 {c}{c}a \n{c}" for c in points]
    found = library.encode_batch(texts, add_special_tokens=False)
    assert [counts.of(t) for t in texts] == [len(e.ids) for e in found]


@settings(max_examples=300, deadline=None)
@drawn(st.text(alphabet=st.sampled_from("ab 1'\n\té中s<|>,."), max_size=40) | st.text(max_size=30))
def test_counts_of_any_text(text):
    if not hasattr(test_counts_of_any_text, "held"):
        test_counts_of_any_text.held = Tokenizer.from_file(BYTES), token_counts.Counts(BYTES, token_counts.proven(BYTES))
    library, counts = test_counts_of_any_text.held
    assert counts.of(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_forgetting_changes_no_count(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    counts, library = token_counts.Counts(BYTES, token_counts.proven(BYTES)), Tokenizer.from_file(BYTES)
    text = prose(500, 5) + " unproven zzqxv " + prose(20, 6)
    assert counts.of(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert len(counts) <= 3


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.proven(public_tokenizers.path("word_bpe_49k.json"))


# alignment

class Plain:
    """Whole texts, decoded bytes only."""

    def __init__(self):
        self.a = Tokenizer.from_file(BYTES)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        byte_of = token_counts.byte_characters()
        self.of_a = {i: bytes(byte_of.get(c, 0) for c in t) for t, i in self.a.get_vocab(False).items()}

    def of_b(self, i):
        piece = self.b.id_to_piece(i)
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return None
        ids = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        said = [self.of_a[i] for i in ids[0]], [self.of_b(i) for i in ids[1]]
        if any(b"".join(s) != (" " + text).encode() for s in said):
            return None
        ends = [list(itertools.accumulate(map(len, s))) for s in said]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        return [tuple([i for i, e in zip(ids[k], ends[k]) if low < e <= high] for k in (0, 1))
                for low, high in zip([0, *cuts], cuts)]


def aligned(given):
    plain = Plain()
    grouped = [(d, plain.groups(t)) for d, t in given]
    links = [Counter((a, b) for x, y in g or () for a in x for b in y) for _, g in grouped]
    held = Counter(p for n in links for p in n)
    most = {}
    for (a, _), n in held.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for (d, g), n in zip(grouped, links):
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g or ())
        out.append((d, sum(len(x) for x, _ in g or ()), sum(len(y) for _, y in g or ()), len(g or ()), n.total(),
                    sum(k for p, k in n.items() if held[p] == most[p[0]]), sum(k * held[p] for p, k in n.items()),
                    hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def test_alignment_of_awkward_texts(spark):
    given = [(i, t if t is None or len(t) < 5000 else t[:5000]) for i, t in mixed()]
    assert rows(alignment.alignment_digests(documents(spark, given), BYTES, PIECES)) == aligned(given)


def test_blocks_and_forgetting_change_nothing(spark, monkeypatch):
    given = [(r["doc_id"], r["text"][:1500]) for r in table_texts()]
    expected = aligned(given)
    docs = documents(spark, given)
    assert rows(alignment.alignment_digests(docs, BYTES, PIECES)) == expected
    small = {"BLOCK": 300, "REMEMBERED": 500, "BATCH": 4000}
    kept = {k: getattr(alignment, k) for k in small}
    for k, v in small.items():
        monkeypatch.setattr(alignment, k, v)
    assert rows(alignment.alignment_digests(docs, BYTES, PIECES)) == expected
    assert kept["BLOCK"] > 300


def test_alignment_of_an_empty_table(spark):
    assert rows(alignment.alignment_digests(documents(spark, []), BYTES, PIECES)) == []
    assert rows(token_counts.token_counts(documents(spark, []), BYTES)) == []
    assert rows(spelling.spelling_variants(documents(spark, []))) == []


@settings(max_examples=300, deadline=None)
@drawn(st.text(alphabet=st.sampled_from("ab 1'\n\té中😀▁s,.!_²\u0301"), max_size=30) | st.text(max_size=20))
def test_groups_of_any_text(text):
    if not hasattr(test_groups_of_any_text, "held"):
        test_groups_of_any_text.held = Plain(), alignment.Aligner(BYTES, PIECES)
    plain, aligner = test_groups_of_any_text.held
    known = alignment.Stretches(aligner)
    (found,), groups = known.whole([text]), plain.groups(text)
    assert (found is None) == (groups is None)
    if groups:
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        assert found[1] == hashlib.sha256(said.encode()).hexdigest()
        links = Counter(a << 32 | b for x, y in groups for a in x for b in y)
        assert dict(zip(found[2].tolist(), found[3].tolist())) == links


# spelling

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def variants(given):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen = Counter()
    for i, text in given:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    counts = {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}
    near = {w: [] for w in counts}
    parts = {}
    for w in counts:  # one edit leaves one of the halves whole
        for m in {len(w), len(w) - 1}:
            for part in ((m, w[:m // 2]), (m, w[len(w) - (m - m // 2):], "")):
                parts.setdefault(part, []).append(w)
    pairs = {p for words in parts.values() for p in itertools.combinations(sorted(words), 2) if one_edit(*p)}
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    form = {}
    for w, words in near.items():
        best = min(words, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted(((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()), key=repr)


def test_acceptors_find_what_comparing_finds():
    for seed in range(300):
        draw = random.Random(seed)
        m, letters = draw.choice([3, 4, 5]), "ab" if seed % 2 else "abcé"
        words = sorted({"".join(draw.choice(letters) for _ in range(draw.choice([m, m + 1])))
                        for _ in range(draw.choice([0, 1, 3, 10, 60]))})
        short, long = ([w for w in words if len(w) == n] for n in (m, m + 1))
        found = [tuple(sorted((short[i], (long if inserted else short)[j]))) for i, j, inserted in
                 spelling.near_pairs(spelling.Acceptor(short), spelling.Acceptor(long))]
        expected = [(a, b) for a, b in itertools.combinations(words, 2)
                    if one_edit(a, b) and m in (len(a), len(b))]
        assert sorted(found) == sorted(tuple(sorted(p)) for p in expected)


def test_acceptor_is_minimal():
    ends = ["ing", "s", "ed"]
    words = sorted(a + e for a in ("walk", "talk", "jump") for e in ends)
    built = spelling.Acceptor(words)
    reached, todo = {0}, [0]
    while todo:
        for t in built.arcs[todo.pop()].values():
            if t not in reached:
                reached.add(t)
                todo.append(t)
    # One state for all equal rests: root, w/t, a, l, j, u, m, then the shared endings.
    assert len(reached) == len({tuple(sorted(w[len(p):] for w in words if w.startswith(p)))
                                for p in {w[:i] for w in words for i in range(len(w) + 1)}})


def spelled(seed, n=400):
    draw = random.Random(seed)
    base = ["".join(draw.choice("abcdeé") for _ in range(draw.randrange(4, 9))) for _ in range(25)]
    out = []
    for _ in range(n):
        w = draw.choice(base[:draw.randrange(1, 26)])
        at = draw.randrange(len(w))
        out.append(draw.choice([w, w, w.upper(), w[:at] + w[at + 1:], w[:at] + "x" + w[at:], w[:at] + "y" + w[at + 1:]]))
    return " ".join(out)


def test_variants_of_awkward_texts(spark):
    long = "abcdefghij" * 2000
    given = mixed() + [(i, spelled(i)) for i in range(200, 230)] + [(None, spelled(3)), (200, spelled(200))] + [
        (300 + i, f"{long} {long[:-1]}x {long[1:]} ÀÉÎÕ× àéîõ÷ {'aaaaab ' * 3}{'aaaab ' * 7} İstanbul") for i in range(4)]
    assert rows(spelling.spelling_variants(documents(spark, given))) == variants(given)


def test_variants_of_a_whole_table(spark):
    given = [(r["doc_id"], r["text"]) for r in table_texts()]
    found = rows(queries.op13_spelling(spark, "/root/testdata/sf0.001"))
    assert found == variants(given)
    assert any(r[1] for r in found) and any(r[2] not in (r[0], r[1]) for r in found)


def test_chains_end_at_their_last_form(spark):
    chain = [(f"w{i}", f"w{i + 1}" if i < 40 else None) for i in range(41)] + [("alone", None)]
    found = dict(rows(spelling.roots(spark.createDataFrame(chain, "word string, form string"))))
    assert found == {**{f"w{i}": "w40" for i in range(41)}, "alone": "alone"}

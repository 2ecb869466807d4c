"""The pipeline stage by stage against plain versions, odd columns, and the registered queries next to their SQL."""

import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from llm_fixtures import awkward, prose
from pyspark.sql import functions as F

import corpus_pipeline
from compare import connect, difference
from srcstrata.llm import exact, pii, rules, simhash
from srcstrata.llm.oracle import ORACLE
from srcstrata.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
# Names that the operators use themselves, and c0, which they give to other columns.
CLASHING = ["__id", "__text", "__hash", "__email", "__all", "__terms", "__text_sha256", "__size", "__maybe", "__word",
            "__mask", "__gone", "__keep_id", "__measured", "m_failed", "component_id", "c0", "c1", "now"]


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def mails():
    """Documents that pass the rules and hold personal data, copies and near copies of them."""
    out = []
    for i in range(6):
        text = f"{prose(90, 50 + i)} mail u{i}@x.org or +1 (487) 555-720{i} now {prose(40, 80 + i)}"
        out += [(500 + i, text), (520 + i, text.upper() if i % 2 else text), (540 + i, text + " more")]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small table with awkward rows, repeated rows and columns of clashing names."""
    where = str(tmp_path_factory.mktemp("pipeline"))
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(None if i is None else 1000 + i, t) for i, t in awkward() + mails()], "doc_id long, text string").withColumns(
        {"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text")})
    odd = odd.select(*[F.col(c).cast(given.schema[c].dataType) for c in given.columns])
    extra = {c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING}
    given.unionByName(odd).withColumns(extra).write.parquet(f"{where}/documents.parquet")
    return where


@pytest.fixture(scope="module")
def stages(spark, folder):
    """(input, output) of every stage, as the pipeline runs them."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{i}")
        after = spark.read.parquet(f"{folder}/stage{i}")
        out[name] = docs, after
        docs = after
    return out


def sql(table, name):
    """Rows of an operator's SQL over a stage's input."""
    con = duckdb.connect()
    documents = table.select("doc_id", "text").toArrow()  # noqa: F841  the view reads it
    con.execute("create view documents_ as select * from documents")
    return con.execute(ORACLE[name].replace("from documents", "from documents_")).fetchall(), [
        d[0] for d in con.description]


def test_columns_stay(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name
        for r in after.select("doc_id", *CLASHING).collect():
            said = "none" if r.doc_id is None else r.doc_id
            assert all(r[c] == f"{c} {said}" for c in CLASHING), name


def test_rules_stage(stages):
    before, after = stages["quality rules"]
    found, names = sql(before.filter("doc_id is not null"), "op4_quality_rules")
    at = {n: i for i, n in enumerate(names)}
    kept = {r[at["doc_id"]] for r in found if r[at["kept"]]}
    # Repeated ids hold equal texts here.
    assert {r.doc_id for r in after.collect()} - {None} == kept
    assert 0 < after.count() < before.count()


def test_exact_stage(stages):
    before, after = stages["exact dedup"]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    largest = {}
    for r in before.collect():
        text = (r.text or "").translate(lower)
        largest[text] = max((x for x in (largest.get(text), r.doc_id) if x is not None), default=None)
    got = [((r.text or "").translate(lower), r.doc_id) for r in after.collect()]
    assert sorted(got, key=repr) == sorted(largest.items(), key=repr)
    assert after.count() < before.count()


def test_near_stage(stages):
    before, after = stages["SimHash near-dedup"]
    given = before.collect()
    prints = np.array([simhash.simhash(r.text or "") for r in given], np.uint64)
    root = list(range(len(given)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(given)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1:] ^ prints[i]) <= 3) + i + 1:
            root[find(i)] = find(int(j))
    groups = defaultdict(list)
    for i, r in enumerate(given):
        groups[find(i)].append(r.doc_id)
    kept = sorted([min((x for x in ids if x is not None), default=None) for ids in groups.values()], key=repr)
    assert sorted([r.doc_id for r in after.filter("doc_id is not null").collect()], key=repr) == [
        k for k in kept if k is not None]
    assert after.count() < before.count()


def test_sanitised_stage(stages):
    before, after = stages["PII"]
    assert after.count() == before.count()
    held = {(r.doc_id, r["c0"]): r for r in before.collect()}
    spans = {r.doc_id: r.spans for r in pii.detect(before).collect()}
    changed = 0
    for r in after.collect():
        old = held[r.doc_id, r["c0"]]
        if spans[r.doc_id]:
            changed += 1
            assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.", r.text) and r.n_chars == len(r.text)
            assert "x.org" not in r.text
        else:
            assert r.text == old.text and r.n_chars == old.n_chars
    assert changed >= 6


def test_packed_stage(stages):
    from tokenizers import Tokenizer
    import public_tokenizers
    before, after = stages["best-fit packing"]
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.PACKING_VOCABULARY))
    expected = []
    for r in before.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        expected += [(r.doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
                     for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert rows(after.select("doc_id", "piece", "start", "length", "ids_crc32")) == sorted(expected, key=repr)
    filled = defaultdict(list)
    for r in after.collect():
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_gives_the_last_stage(spark, folder, stages):
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(corpus_pipeline.run(spark, folder).select(*fields)) == rows(
        stages["best-fit packing"][1].select(*fields))


def test_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# what ended jobs or let texts through

def test_words_cut_by_an_entity_are_counted_like_others(spark):
    given = [(i, f"x4111 1111 1111 1111 said {i} things of x") for i in range(3)] + [(9, "mail x@y.org now")]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.detect(docs).collect()}
    assert [found[i].n_card for i in range(3)] == [1, 1, 1] and found[9].n_email == 1
    after = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "4111" not in "".join(after.values()) and "@" not in after[9]


@pytest.mark.parametrize("operator", [rules.keep, exact.deduplicate, simhash.deduplicate, pii.sanitise])
def test_clashing_columns_come_back_as_they_were(spark, operator):
    text = f"{prose(70, 1)} mail a@b.org now"
    docs = spark.createDataFrame([(1, text), (2, text), (3, prose(80, 2))], "doc_id long, text string")
    plain = {r.doc_id: r.text for r in operator(docs).collect()}
    held = docs.withColumns({c: F.lit(f"secret of {c}") for c in CLASHING})
    found = operator(held)
    assert found.columns == held.columns
    assert {r.doc_id: r.text for r in found.collect()} == plain
    for r in found.collect():
        assert all(r[c] == f"secret of {c}" for c in CLASHING)


# the queries

@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_give_whole_tables(spark, con, name):
    if name in ORACLE:
        assert difference(spark, con, FOLDER, name) is None
        return
    frame = QUERIES[name](spark, FOLDER)
    found = frame.collect()
    whole = {"op7_html_extract": "pages"}.get(name, "documents")
    if name == "op13_spelling":
        assert found and len({r.word for r in found}) == len(found)
    else:
        key = "page_id" if whole == "pages" else "doc_id"
        expected = con.execute(f"select {key} from {whole}").fetchall()
        ids = {r[key] for r in found}
        assert ids == {i for (i,) in expected}
        assert name == "op10_packing" or len(found) == len(expected)

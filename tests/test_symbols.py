"""Symbol extraction on lines whose results are known by hand."""

import random

import pytest
from pyspark.sql import functions as F

from srcstrata.functions import patterns as P
from srcstrata.functions.text import LINE_END
from srcstrata.operators import search, symbols


def files(spark, *rows):
    return symbols.with_lines(spark.createDataFrame(
        [(1, 1, path, language, content) for path, language, content in rows],
        "repository_id long, branch_id long, path string, language string, content string"))


def methods(spark, language, content):
    row = files(spark, ("f", language, content)).select(
        symbols.method_matches(F.col("language"), F.col("lines")).alias("m")).first()
    return list(row.m)


def classes(spark, language, content):
    row = files(spark, ("f", language, content)).select(
        symbols.class_matches(F.col("language"), F.col("lines")).alias("c")).first()
    return list(row.c)


@pytest.mark.parametrize("language, line, expected", [
    ("Java", "if (foo(x)) {", []),
    ("Java", "foo(bar(x));", ["foo"]),
    ("Java", "$foo(x)", ["foo"]),
    ("Java", "héllo(x)", []),
    ("Java", "synchronized (this) {", ["synchronized"]),
    ("Java", "void a() throws X, Y {", ["a"]),
    ("JavaScript", "x = function (a) {", ["function"]),
    ("JavaScript", "function q(a) {", ["q", "q"]),
    ("JavaScript", "const k = async (a) => a(b)", ["k", "async"]),
    ("TypeScript", "let f = x => x", ["f"]),
    ("Python", "async def f(x):", []),
    ("Python", "  def g(x): h(y)", ["g"]),
    ("Go", "func main() {", ["main"]),
])
def test_methods(spark, language, line, expected):
    assert methods(spark, language, line) == expected


@pytest.mark.parametrize("language, line, expected", [
    ("Java", "// see class of things", ["of"]),
    ("Java", "record P(int x)", ["P"]),
    ("Java", "enum A interface B", ["A", "B"]),
    ("Python", "x = 1; class A:", []),
    ("Python", "class _A(B):", ["_A"]),
    ("Rust", "subclass X", []),
])
def test_classes(spark, language, line, expected):
    assert classes(spark, language, line) == expected


def test_a_match_does_not_cross_lines(spark):
    assert methods(spark, "Java", "foo(\nbar)") == []
    assert classes(spark, "Java", "class\nA") == []


def parsed(spark, *rows):
    found = symbols.file_symbols(symbols.match_symbols(files(spark, *rows)))
    return ({(r.path, r.name): (r.loc, r.method_count) for r in symbols.class_rows(found).collect()},
            {(r.path, r.class_name, r.name) for r in symbols.method_rows(found).collect()})


def test_names_are_numbered_and_methods_go_to_the_first_class(spark):
    got_classes, got_methods = parsed(
        spark,
        ("a.js", "JavaScript", "class A {\nclass B {\nclass A {\n\nfunction q(x) {\n"),
        ("d/only.test.py", "Python", "def f(x):\ndef f(y):\n"),
        ("empty.go", "Go", "// nothing\n"),
        ("P.java", "Java", "record P(int x) {"))
    assert got_classes == {("a.js", "A"): (4, 2), ("a.js", "B"): (4, 0), ("a.js", "A#2"): (4, 0),
                           ("d/only.test.py", "only.test"): (2, 2), ("P.java", "P"): (1, 1)}
    assert got_methods == {("a.js", "A", "q"), ("a.js", "A", "q#2"),
                           ("d/only.test.py", "only.test", "f"), ("d/only.test.py", "only.test", "f#2"),
                           ("P.java", "P", "P")}


def test_nested_form_flattens_to_the_same_rows(spark):
    rows = [("a.js", "JavaScript", "class A {\nclass A {\nfunction q(x) {\n"),
            ("f.py", "Python", "def f(x):\n"), ("e.go", "Go", "// nothing\n")]
    matched = symbols.match_symbols(files(spark, *rows))
    flat_files, flat_classes, flat_methods = symbols.flatten_parse_tree(symbols.parse_tree(matched))
    found = symbols.file_symbols(matched)
    assert flat_files.count() == 3
    assert sorted(flat_classes.collect()) == sorted(symbols.class_rows(found).collect())
    assert sorted(flat_methods.collect()) == sorted(symbols.method_rows(found).collect())


def test_totals_equal_the_rows(spark):
    matched = symbols.match_symbols(files(
        spark, ("a.js", "JavaScript", "class A {\nfunction q(x) {\n"), ("f.py", "Python", "def f(x):"),
        ("e.go", "Go", "\n")))
    row = symbols.scan_totals(matched).first()
    assert (row.file_count, row.class_count, row.method_count) == (3, 2, 3)


def test_malformed_bytes(spark):
    df = spark.createDataFrame([(1, 1, "a.py", "Python", bytearray(b"ok")),
                                (1, 1, "b.py", "Python", bytearray(b"\xff\xfe"))],
                               "repository_id long, branch_id long, path string, language string, "
                               "content binary")
    good, bad = symbols.split_malformed(df)
    assert [r.path for r in good.collect()] == ["a.py"]
    assert [r.path for r in bad.collect()] == ["b.py"]
    assert symbols.decode_source(good).first().lines == ["ok"]
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        symbols.decode_source(df).collect()


def test_dependencies_count_every_pair(spark):
    named = search.file_names(files(
        spark, ("a.java", "Java", "class A {\nB b; C c;"), ("b1.java", "Java", "class B {"),
        ("b2.java", "Java", "class B {\nclass C {\nA a;")))
    edges = {(r.source_path, r.target_class): r.target_files
             for r in search.class_dependencies(named).collect()}
    assert edges == {("a.java", "B"): 2, ("a.java", "C"): 1, ("b2.java", "A"): 1,
                     ("b1.java", "B"): 1, ("b2.java", "B"): 1}
    rows = search.dependency_rows(search.class_dependencies(named))
    assert {(r.source_path, r.target_class): r.target_files for r in rows.collect()} == edges
    counted = search.dependency_counts(search.class_dependencies(named)).first().dependency_count
    assert rows.agg({"target_files": "sum"}).first()[0] == counted == 6


def test_dependencies_match_every_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def counted(lines):
        read.add(1)
        return lines

    texts = files(spark, ("a.java", "Java", "class A {\nB b;"), ("b.java", "Java", "class B {"), ("C.java", "Java", "void f() {}"))
    named = search.file_names(texts.withColumn("lines", counted.asNondeterministic()("lines")))
    assert [(r.source_path, r.target_class) for r in search.class_dependencies(named).collect()] == [("a.java", "B")]
    assert read.value == 3


def test_names_and_symbols_of_one_pass(spark):
    texts = files(spark, ("a.java", "Java", "class A {\nclass A {\nB b;"), ("m.js", "JavaScript", "function q(x) {\nif (x) {"),
                  ("e.go", "Go", "// nothing\r\n\r"), ("k.py", "Python", "if (x):"), ("n.py", "Python", ""))
    found = search.match_names(texts)
    assert sorted(found.drop("tokens").collect()) == sorted(symbols.match_symbols(texts).collect())
    names = search.matched_names(found).collect()
    assert sorted(names) == sorted(search.file_names(texts).collect())
    assert {r.path: r.class_names for r in names} == {"a.java": ["A"], "m.js": ["m"], "e.go": [], "k.py": [], "n.py": []}


def test_line_ends_are_those_of_the_plain_pattern(spark):
    draw = random.Random(7)
    rows = [("".join(draw.choices(["a", "\r", "\n", "\r\n", "\u0085", "é"], k=draw.randrange(12))),) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "t string")
    assert frame.filter(~(F.split("t", LINE_END, -1) == F.split("t", r"\r\n|\r|\n", -1))).collect() == []


def test_methods_are_the_pattern_s_in_linear_time(spark):
    draw = random.Random(4)
    parts = ["f", "f(", "f(", "$g", "a$b", "9x", "if", "(", ")", "(", ")", ")", ")", ";", "{", "}", " ", "  ", "throws", " A, B", ".", "=",
             "é", "\t", "_"]
    lines = ["".join(draw.choices(parts, k=draw.randrange(24))) for _ in range(4000)]
    frame = spark.createDataFrame([(line,) for line in lines], "line string")
    plain = F.regexp_extract_all("line", F.lit(P.JAVA_LIKE_METHOD), F.lit(1))
    assert frame.filter(~(symbols._java_like_methods(F.col("line")) == plain)).collect() == []
    assert frame.filter(F.size(plain) > 0).count() > 500
    long = spark.createDataFrame([("f(" * 250_000,), ("a$" * 500_000,), ("f(" * 250_000 + ")",)], "line string")
    assert [r[0] for r in long.select(symbols._java_like_methods(F.col("line"))).collect()] == [[], [], ["f"]]

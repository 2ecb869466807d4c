"""Text rules on the cases SQL over the given tables cannot hold."""

import pytest
from pyspark.sql import functions as F

from srcstrata.functions import language as L
from srcstrata.functions import text as X


def value(spark, expression, text):
    df = spark.createDataFrame([(text,)], "c string")
    return df.select(expression(F.col("c")).alias("v")).first().v


@pytest.mark.parametrize("text, expected", [
    ("", False), (None, False), (" \t", False), ("\u2003", False), ("\x0b\x1c", False),
    ("\u00a0", True), ("a", True), ("\n x", True)])
def test_has_text(spark, text, expected):
    assert value(spark, X.has_text, text) is expected


@pytest.mark.parametrize("text, expected", [
    ("  a b\u2003\n", "a b"), ("\u00a0a", "\u00a0a"), ("a \u0085", "a \u0085"), ("   ", "")])
def test_strip(spark, text, expected):
    assert value(spark, X.strip, text) == expected


@pytest.mark.parametrize("text, expected", [
    ("https://h/org/project.git", "project"), ("git@h:org/p.git", "p"), ("git@h:p", "p"),
    ("https://h/x/", "fallback"), ("plain", "plain"), (" https://h/p.git ", "p"),
    ("https://h/.git", "fallback"), ("https://h/a.git.git", "a.git")])
def test_repository_name(spark, text, expected):
    assert value(spark, lambda c: X.derive_repository_name(c, F.lit("fallback")), text) == expected


def test_repository_key_hashes_the_raw_url(spark):
    import hashlib
    url = " https://h/my repo.git "
    expected = "my-repo-" + hashlib.sha256(url.encode()).hexdigest()[:12]
    assert value(spark, X.repository_key, url) == expected


@pytest.mark.parametrize("text, expected", [
    ("a.test.ts", "a.test"), (".py", ".py"), ("x/y/Main.java", "Main"), ("noext", "noext"),
    ("d.ir/noext", "noext"), ("a.", "a")])
def test_fallback_class_name(spark, text, expected):
    assert value(spark, X.fallback_class_name, text) == expected


@pytest.mark.parametrize("text, expected", [
    (None, "required"), (" ", "required"), ("git@host:x", None), ("https://h/x", None),
    ("ssh://git@h/x", None), ("http://h", None), ("HTTPS://h/x", "scheme"), ("ftp://h/x", "scheme"),
    ("h/x", "scheme"), ("mailto:x", "scheme"), ("https:///x", "host"), ("https://h/a b", "invalid"),
    ("https://", "invalid"), ("https://h_x/p", "host")])
def test_url_problem(spark, text, expected):
    assert value(spark, X.url_problem, text) == expected


@pytest.mark.parametrize("text, expected", [
    ("a\nb\r\nc\rd", ["a", "b", "c", "d"]), ("a\n", ["a"]), ("", []), ("\n\n", ["", ""]),
    ("a\n\nb", ["a", "", "b"]), ("a\x0bb\u2028c", ["a\x0bb\u2028c"])])
def test_split_lines(spark, text, expected):
    assert value(spark, X.split_lines, text) == expected


@pytest.mark.parametrize("path, expected", [
    ("py", "Python"), ("a/B.KTS", "Kotlin"), ("x.h", "C/C++"), ("x.test.tsx", "TypeScript"),
    (".py", "Python"), ("a.py/readme", None), ("x.", None), ("Makefile", None), ("a.cs", "C#")])
def test_language(spark, path, expected):
    assert value(spark, L.detect_language, path) == expected


@pytest.mark.parametrize("path, expected", [
    ("build/a.py", True), ("src/Build/a.py", False), ("a/out", True), ("src/builder/a.py", False),
    ("a/__pycache__/x.py", True), (".github/x.js", False), ("a/.git/x", True)])
def test_skipped(spark, path, expected):
    assert value(spark, L.is_skipped, path) is expected


def test_file_uri_quotes_like_a_path_uri(spark):
    assert value(spark, X.file_uri, "/d/a b+c~é%#@") == "file:///d/a%20b+c~%C3%A9%25%23@/"


def test_relative_path(spark):
    assert value(spark, lambda c: X.relative_path(F.lit("C:\\r"), c), "C:\\r\\a\\b.py") == "a/b.py"


def test_instant_honours_the_offset(spark):
    v = value(spark, lambda c: X.instant(c).cast("timestamp_ntz"), "2026-01-02T03:04:05+02:00")
    assert str(v) == "2026-01-02 01:04:05"

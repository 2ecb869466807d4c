"""Classes and methods of source files.

Input ``files`` has one row per file: ``repository_id, branch_id, path,
language, lines`` (see :func:`with_lines`). Matching runs inside the file's row
and keeps the order (line, pattern, match) as array order, so counts need no
shuffle at all. Only naming duplicates needs one, on the file key; a file is
capped at 1 MB, so no group can grow with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcstrata.functions import patterns as P
from srcstrata.functions.text import fallback_class_name, has_text, split_lines
from srcstrata.operators.relational import null_safe_join
from srcstrata.schemas import FILE_KEY


def file_key(path: str = "path") -> Column:
    """Surrogate key of a file: a hash of its natural key, made when it is scanned and kept from then on."""
    return F.sha2(F.concat_ws("/", "repository_id", F.coalesce(F.col("branch_id").cast("string"), F.lit("")), path), 256
                  ).alias("file_key")


def with_lines(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("lines", split_lines(F.col(content))).drop(content)


def decode_source(files: DataFrame, content: str = "content") -> DataFrame:
    """Strict UTF-8 decoding of binary content: malformed bytes fail the job."""
    return with_lines(files.withColumn(content, F.decode(F.col(content), "UTF-8")), content)


def split_malformed(files: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Permissive decoding: (readable files, files whose bytes are not UTF-8)."""
    valid = F.is_valid_utf8(F.col(content))
    return files.filter(valid), files.filter(~valid)


def file_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 0."""
    return files.select(*FILE_KEY, "language", F.posexplode_outer("lines").alias("line_no", "line")
                        ).filter("line IS NOT NULL")


def line_count(lines: Column) -> Column:
    """Lines with text."""
    return F.size(F.filter(lines, has_text))


def _java_like_methods(line: Column) -> Column:
    """What ``JAVA_LIKE_METHOD`` matches, in time linear in the line."""
    def head(piece: Column) -> Column:
        before = F.left(piece, F.length(piece) - F.length(F.substring_index(piece, ")", -1)))
        return F.regexp_extract(before, P.METHOD_HEAD, 1)
    return F.filter(F.transform(F.split(line, P.STATEMENT_END, -1), head), lambda name: name != "")


def _matches(lines: Column, *patterns: str) -> Column:
    def of_line(line: Column) -> Column:
        found = [_java_like_methods(line) if p == P.JAVA_LIKE_METHOD else
                 F.regexp_extract_all(line, F.lit(p), F.lit(1)) for p in patterns]
        return found[0] if len(found) == 1 else F.concat(*found)
    return F.flatten(F.transform(lines, of_line))


def class_matches(language: Column, lines: Column) -> Column:
    """Class-like names of a file in order of appearance, duplicates included."""
    return (F.when(language == "Python", _matches(lines, P.PYTHON_CLASS))
            .otherwise(_matches(lines, P.CLASS)))


def without_control_keywords(names: Column) -> Column:
    return F.filter(names, lambda name: ~name.isin(P.CONTROL_KEYWORDS))


def call_like_matches(language: Column, lines: Column) -> Column:
    """What the language's method patterns match, control keywords included."""
    return (
        F.when(language == "Python", _matches(lines, P.PYTHON_METHOD))
        .when(language.isin("JavaScript", "TypeScript"),
              _matches(lines, P.FUNCTION, P.ARROW_FUNCTION, P.JAVA_LIKE_METHOD))
        .otherwise(_matches(lines, P.JAVA_LIKE_METHOD))
    )


def method_matches(language: Column, lines: Column) -> Column:
    """Method names of a file in order of appearance, control keywords dropped.

    A dropped keyword has consumed its text: calls inside its parentheses stay lost.
    """
    return without_control_keywords(call_like_matches(language, lines))


def match_symbols(files: DataFrame) -> DataFrame:
    """Adds ``loc``, ``class_names`` and ``method_names``, and drops the lines."""
    return files.select(
        *[c for c in files.columns if c != "lines"],
        line_count(F.col("lines")).alias("loc"),
        class_matches(F.col("language"), F.col("lines")).alias("class_names"),
        method_matches(F.col("language"), F.col("lines")).alias("method_names"),
    )


def raw_symbols(matched: DataFrame, column: str) -> DataFrame:
    """One row per match: file key, position in the file, name as written.

    An inner explode would make the optimizer add a size filter below it, and
    with it a second evaluation of the patterns; the outer one is evaluated once.
    """
    return matched.select(*FILE_KEY, F.posexplode_outer(column).alias("seq", "raw_name")).filter(
        "raw_name IS NOT NULL")


def numbered_name(raw_name: Column, occurrence: Column) -> Column:
    """``N``, then ``N#2``, ``N#3`` ..."""
    return F.when(occurrence == 1, raw_name).otherwise(
        F.concat(raw_name, F.lit("#"), occurrence.cast("string")))


def unique_names(symbols: DataFrame, *kind: str) -> DataFrame:
    """Names each repeated symbol of a file apart, in order of appearance."""
    w = Window.partitionBy(*FILE_KEY, *kind, "raw_name").orderBy("seq")
    return symbols.withColumn("name", numbered_name(F.col("raw_name"), F.row_number().over(w)))


def file_symbols(matched: DataFrame) -> DataFrame:
    """Every class and method row of the scan, named and attached.

    ``kind`` is ``class`` or ``method``. All methods of a file belong to its
    first class; a file with methods only gets one class named after the file.
    The file key is the only shuffle key: the windows below share it.
    """
    exploded = matched.select(
        *FILE_KEY, "loc",
        F.when(F.size("class_names") > 0, F.col("class_names")[0])
        .when(F.size("method_names") > 0, fallback_class_name(F.col("path")))
        .alias("first_class"),
        F.size("method_names").alias("methods_in_file"),
        F.explode_outer(F.concat(
            F.when(F.size("class_names") > 0, _tagged("class_names", "class"))
            .when(F.size("method_names") > 0, F.array(F.struct(
                F.lit("class").alias("kind"), F.lit(0).alias("seq"),
                fallback_class_name(F.col("path")).alias("raw_name"))))
            .otherwise(_tagged("class_names", "class")),
            _tagged("method_names", "method"),
        )).alias("s"),
    ).filter("s IS NOT NULL").select(*FILE_KEY, "loc", "first_class", "methods_in_file", "s.*")
    named = unique_names(exploded.repartition(*FILE_KEY), "kind")
    is_class = F.col("kind") == "class"
    return named.select(
        *FILE_KEY, "kind", "seq", "name",
        F.when(~is_class, F.col("first_class")).alias("class_name"),
        F.when(is_class, F.col("loc")).otherwise(0).alias("loc"),
        F.when(is_class & (F.col("seq") == 0), F.col("methods_in_file"))
        .otherwise(0).alias("method_count"),
    )


def _tagged(column: str, kind: str) -> Column:
    return F.transform(F.col(column), lambda name, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("seq"), name.alias("raw_name")))


def class_rows(symbols: DataFrame) -> DataFrame:
    """Rows of ``classes``: loc is the file's, method_count what is attached."""
    return symbols.filter("kind = 'class'").select(*FILE_KEY, "name", "loc", "method_count", file_key())


def method_rows(symbols: DataFrame) -> DataFrame:
    """Rows of ``methods``; no length or complexity is measured, both are 0."""
    return symbols.filter("kind = 'method'").select(
        *FILE_KEY, "class_name", "name", F.lit(0).alias("loc"), F.lit(0).alias("complexity"), file_key())


def file_rows(matched: DataFrame, scan_run_id: Column | None = None) -> DataFrame:
    """Rows of ``source_files``."""
    scan = F.lit(None).cast("long") if scan_run_id is None else scan_run_id
    return matched.select("repository_id", "branch_id", scan.alias("scan_run_id"), "path",
                          "language", "loc", file_key())


def parse_tree(matched: DataFrame) -> DataFrame:
    """Nested form, one row per file: ``classes array<struct<name, loc, methods array<...>>>``."""
    symbols = file_symbols(matched)
    trees = symbols.groupBy(*FILE_KEY).agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "class", F.struct("seq", "name", "loc"))))
        .alias("c"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "method", F.struct("seq", "name"))))
        .alias("m"),
    )
    methods = F.transform("m", lambda m: F.struct(
        m["name"].alias("name"), F.lit(0).alias("loc"), F.lit(0).alias("complexity")))
    classes = F.transform("c", lambda c: F.struct(
        c["name"].alias("name"), c["loc"].alias("loc"),
        F.when(c["seq"] == 0, methods).otherwise(F.slice(methods, 1, 0)).alias("methods")))
    return null_safe_join(matched.select(*FILE_KEY, "language", "loc"),
                          trees.select(*FILE_KEY, classes.alias("classes")), FILE_KEY, "left")


def flatten_parse_tree(trees: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nested form back into files, classes and methods; class-less files stay files."""
    files = trees.select(*FILE_KEY, "language", "loc")
    classes = trees.select(*FILE_KEY, F.explode("classes").alias("c")).select(
        *FILE_KEY, "c.name", "c.loc", F.size("c.methods").alias("method_count"), "c.methods")
    methods = classes.select(*FILE_KEY, F.col("name").alias("class_name"),
                             F.explode("methods").alias("m")).select(
        *FILE_KEY, "class_name", "m.name", "m.loc", "m.complexity")
    return files, classes.drop("methods").select("*", file_key()), methods.select("*", file_key())


def scan_totals(matched: DataFrame, keys: Sequence[str] = ("repository_id", "branch_id")) -> DataFrame:
    """Files, classes and methods per repository and branch, without naming symbols."""
    n_classes = F.size("class_names")
    n_methods = F.size("method_names")
    stored_classes = F.when((n_classes == 0) & (n_methods > 0), 1).otherwise(n_classes)
    return matched.groupBy(*keys).agg(
        F.count("*").cast("int").alias("file_count"),
        F.sum(stored_classes).cast("int").alias("class_count"),
        F.sum(n_methods).cast("int").alias("method_count"),
    )


def file_class_method_join(files: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """Files with their classes and methods through the file's key."""
    f = files.select(*FILE_KEY, "language", "file_key")
    c = classes.select("file_key", F.col("name").alias("class_name"))
    m = methods.select("file_key", "class_name", F.col("name").alias("method_name"))
    return f.join(c, "file_key").join(m, ["file_key", "class_name"]).select(
        *FILE_KEY, "language", "class_name", "method_name")

"""Class references, symbol search and vector search over the catalogue."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcstrata.functions import patterns as P
from srcstrata.functions.text import fallback_class_name
from srcstrata.operators.bitmap import bitmap, maybe_in
from srcstrata.operators.relational import null_safe_join
from srcstrata.operators.symbols import class_matches, file_key, match_symbols, method_matches
from srcstrata.schemas import FILE_KEY
from srcstrata.session import shared_folder, stored

_BRANCH = ("repository_id", "branch_id")


def _tokens(lines: Column) -> Column:
    """Identifiers of a file, each once."""
    return F.array_distinct(F.flatten(F.transform(
        lines, lambda line: F.regexp_extract_all(line, F.lit(P.IDENTIFIER), F.lit(0)))))


def _kept_names(path: Column, names: Column, n_methods: Column) -> Column:
    """Names of a file's classes, each once; of a file with methods only, the one named after it."""
    return F.when(F.size(names) > 0, F.array_distinct(names)).when(
        n_methods > 0, F.array(fallback_class_name(path))).otherwise(names)


def file_names(files: DataFrame) -> DataFrame:
    """Per file: the names of its classes, each once and the first class first, and its tokens.

    Methods are matched only where a file has no class: there alone they decide.
    """
    lines, language = F.col("lines"), F.col("language")
    found = files.select(*FILE_KEY, "language", "lines", class_matches(language, lines).alias("names"))
    counted = found.select(*FILE_KEY, "names", F.when(F.size("names") == 0, F.size(method_matches(language, lines))
                                                      ).alias("n_methods"), _tokens(lines).alias("tokens"))
    return counted.select(*FILE_KEY, _kept_names(F.col("path"), F.col("names"), F.col("n_methods")).alias("class_names"),
                          "tokens")


def match_names(files: DataFrame) -> DataFrame:
    """``symbols.match_symbols`` with the files' tokens, found in the same pass over the texts."""
    return match_symbols(files.withColumn("tokens", _tokens(F.col("lines"))))


def matched_names(found: DataFrame) -> DataFrame:
    """What :func:`file_names` gives, from the result of :func:`match_names`."""
    return found.select(*FILE_KEY, _kept_names(F.col("path"), F.col("class_names"), F.size("method_names")
                                               ).alias("class_names"), "tokens")


def class_definitions(named: DataFrame) -> DataFrame:
    """(file key, name) of every class, repeated declarations of a file once."""
    return named.select(*FILE_KEY, F.explode_outer("class_names").alias("name")).filter(
        "name IS NOT NULL")


def class_dependencies(named: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """References from a file's first class to class names of other files of its branch.

    ``named`` comes from :func:`file_names`. One row per (file, referenced name)
    with ``target_files``, the number of other files that define the name. This
    is the whole edge set in factored form: a name defined in n files and used
    in m is m rows and not n x m. See :func:`dependency_rows` for the rows of the
    ``dependencies`` table. ``named`` is read twice; without the ``definitions``
    of a stored scan it is stored first, so texts are read and matched once.
    """
    if definitions is None:
        named = stored(named, "named")
        definitions = class_definitions(named)
    def tagged(tokens: Column, own: int) -> Column:
        return F.transform(tokens, lambda t: F.struct(t.alias("target_class"), F.lit(own).alias("own")))

    names = F.col("class_names")
    uses = named.select(
        *FILE_KEY, F.when(F.size(names) > 0, names[0]).alias("source_class"),
        F.explode_outer(F.when(F.size(names) > 0, F.concat(
            tagged(F.array_intersect("tokens", names), 1),
            tagged(F.array_except("tokens", names), 0)))).alias("use"),
    ).filter("use IS NOT NULL").select(*FILE_KEY, "source_class", "use.*")
    key = (*_BRANCH, "target_class")
    defined = stored(definitions.groupBy(*_BRANCH, F.col("name").alias("target_class"))
                     .agg(F.count("*").alias("n_files")), "definitions")
    # Most tokens are no class's name; a bounded bitmap of the names keeps these out of the shuffle.
    return (null_safe_join(maybe_in(uses, bitmap(defined, *key), *key), defined, key, "inner")
            .withColumn("target_files", F.col("n_files") - F.col("own")).filter("target_files > 0")
            .select(*_BRANCH, F.col("path").alias("source_path"), "source_class", "target_class",
                    "target_files"))


def dependency_counts(edges: DataFrame) -> DataFrame:
    """Number of edges per repository and branch, counted on the factored form."""
    return edges.groupBy(*_BRANCH).agg(F.sum("target_files").alias("dependency_count"))


def dependency_rows(edges: DataFrame) -> DataFrame:
    """Rows of the ``dependencies`` table: every reference, with the number of files it can mean.

    The table keeps the factored form, so no target is left out and its
    ``target_files`` add up to :func:`dependency_counts`; the targets themselves
    are the classes of that name in the branch, other than the source file's.
    """
    return edges.select(*_BRANCH, "source_path", "source_class", "target_class", "target_files",
                        F.lit("reference").alias("dependency_type"), file_key("source_path"))


def symbol_search(classes: DataFrame, methods: DataFrame, prefix: str) -> DataFrame:
    """Classes and methods whose name starts with the prefix, case-sensitive."""
    def hits(rows: DataFrame, kind: str) -> DataFrame:
        return rows.filter(F.startswith("name", F.lit(prefix))).select(
            *FILE_KEY, F.lit(kind).alias("kind"), "name")
    return hits(classes, "class").unionByName(hits(methods, "method"))


# Requests of a block, and vectors a task holds at a time: their product is 32 MB of doubles.
REQUESTS_PER_BLOCK, VECTORS_PER_PASS = 256, 16_384


def semantic_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact cosine top-k: ``query_id, rank, vec_id``; equal scores by id.

    ``queries`` (query_id, embedding) are search requests, ``vectors`` (vec_id,
    embedding) what is searched; both may be of any size. The requests are
    written to the shared folder in blocks. A task reads its vectors once, and
    for every ``VECTORS_PER_PASS`` of them streams the blocks against them with
    one matrix product each, keeping k rows per request: no pair is emitted,
    nothing passes the driver, and a task holds one block next to its vectors.
    The rows of all tasks are then cut to k per request before they are shuffled
    and ranked. Vectors without any length have no cosine and are never returned;
    nulls, and embeddings of another length than the request's, have none either.
    """
    folder = shared_folder(queries.sparkSession, "requests")
    (queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"))
     .filter("embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL)")
     .write.option("maxRecordsPerFile", REQUESTS_PER_BLOCK).parquet(folder))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix in _passes(batches):
            for query_ids, requests in _blocks(folder, matrix.shape[1]):
                yield _best(query_ids, requests, ids, matrix, k)

    found = (vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
             .filter("embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL)")
             .mapInArrow(search, "query_id long, vec_id long, score double"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id"))


def _matrices(batch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of a batch's embeddings, per length; those without any length are left out."""
    ids, column = batch.column(name).to_numpy(zero_copy_only=False), batch.column("embedding")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for width in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == width)
        matrix = values[starts[at][:, None] + np.arange(width)]
        long = (matrix * matrix).sum(axis=1) > 0
        yield ids[at][long], matrix[long]


def _passes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors of one length, ``VECTORS_PER_PASS`` at a time or what there is."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for ids, matrix in _matrices(batch, "vec_id"):
            parts = held.setdefault(matrix.shape[1], [])
            parts.append((ids, matrix))
            if sum(len(i) for i, _ in parts) >= VECTORS_PER_PASS:
                yield tuple(map(np.concatenate, zip(*held.pop(matrix.shape[1]))))
    for parts in held.values():
        yield tuple(map(np.concatenate, zip(*parts)))


def _blocks(folder: str, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The stored requests of one length, a block at a time."""
    from pyarrow import fs
    from pyarrow import parquet as pq
    system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (
        fs.LocalFileSystem(), folder.removeprefix("file:"))
    for info in system.get_file_info(fs.FileSelector(base)):
        if not info.base_name.endswith(".parquet"):
            continue
        with system.open_input_file(info.path) as stream:
            for batch in pq.ParquetFile(stream).iter_batches(REQUESTS_PER_BLOCK):
                for ids, matrix in _matrices(batch, "query_id"):
                    if matrix.shape[1] == width:
                        yield ids, matrix


def _best(query_ids: np.ndarray, requests: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int) -> pa.RecordBatch:
    """(query_id, vec_id, score) of the k best vectors of every request.

    The matrix product only preselects. Its last bits depend on a row's place in
    the block, so the preselected rows are scored again row by row: equal
    vectors then get equal scores and are ordered by id.
    """
    norms, lengths = np.sqrt((matrix * matrix).sum(axis=1)), np.sqrt((requests * requests).sum(axis=1))
    rough = (requests @ matrix.T) / norms  # a row per request
    floor = np.full(len(requests), -np.inf)
    if len(ids) > k:
        floor = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
    request, vector = np.nonzero(rough >= (floor - 1e-9 * lengths)[:, None])
    score = np.empty(len(request))
    for start in range(0, len(request), VECTORS_PER_PASS):
        r, v = request[start:start + VECTORS_PER_PASS], vector[start:start + VECTORS_PER_PASS]
        score[start:start + VECTORS_PER_PASS] = (matrix[v] * requests[r]).sum(axis=1) / (norms[v] * lengths[r])
    order = np.lexsort((ids[vector], -score, request))
    request, vector, score = request[order], vector[order], score[order]
    first = np.searchsorted(request, request, "left")
    kept = np.arange(len(request)) - first < k
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids[request[kept]], pa.int64()), pa.array(ids[vector[kept]], pa.int64()), pa.array(score[kept])],
        names=["query_id", "vec_id", "score"])

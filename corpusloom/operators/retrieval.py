"""Dense, sparse and hybrid top-k search with payload filters.

Filters always come before a branch's top-k. Ties go to the smaller id. Sums of products, whose order Spark does not
fix, are compared to twelve places, so that equal texts tie; other scores are compared as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import stripped_length, tokens
from corpusloom.operators.vectors import slices, unit_terms


#: Terms of rows, and products of theirs with queries' terms, that a task holds at a time when it scores a batch of rows.
TERMS, PRODUCTS = 500_000, 1_000_000


def payload_filter(file_filter: str | None = None, language: str | None = None, is_test: bool | None = None) -> Column:
    """All of the conditions given: part of the path, language, test files or others."""
    conditions = []
    if file_filter:
        conditions.append(F.contains(F.col("filepath"), F.lit(file_filter)))
    if language:
        conditions.append(F.col("language") == language)
    if is_test is not None:
        conditions.append(F.col("is_test") == is_test)
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null where a length is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense_topk(rows: DataFrame, query: list[float], k: int, id_column: str = "point_id", vector: str = "dense") -> DataFrame:
    """id, score: the k rows most similar to one query. Each task keeps its k best; nothing else moves."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return _largest(rows.select(id_column, cosine(F.col(vector), q).alias("score")), k, id_column)


def _best(found: pa.Table, k: int, id_column: str) -> pa.Table:
    """Each query's k best rows of found(query, score, id)."""
    found = found.sort_by([("query", "ascending"), ("score", "descending"), (id_column, "ascending")])
    query = found.column("query").to_numpy()
    return found.take(np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query) < k)).combine_chunks()


def _batch_topk(rows: DataFrame, queries: DataFrame, k: int, id_column: str, vector: str, query_block: int, prepare: Callable, scores: Callable) -> DataFrame:
    """query_id, id, score, rank of rows(id, vector): queries go through in blocks of bounded size, and every task keeps k rows for each.

    prepare(vectors) makes of a block's vectors what tasks get. scores(block, batch) yields, for slices of a batch of
    rows, (first row, scores of rows by queries), NaN where a row takes no part. What is shuffled is tasks x queries x k.
    """
    spark = rows.sparkSession
    n = max(1, -(-queries.count() // query_block))
    id_type, query_type = rows.schema[id_column].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    parts = []
    for number in range(n):
        own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == number).filter(F.col(vector).isNotNull()).select("query_id", vector).orderBy("query_id").collect()
        if not own:
            continue
        sent = spark.sparkContext.broadcast(prepare([r[vector] for r in own]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held, kept = [], 0
            for batch in batches:
                for start, s in scores(sent.value, batch.column(vector)):
                    s = np.where(np.isnan(s), -np.inf, s)
                    edge = np.partition(s, max(len(s) - k, 0), axis=0)[max(len(s) - k, 0)]
                    row, query = np.nonzero((s >= edge) & (s > -np.inf))
                    held.append(pa.table({"query": query, "score": s[row, query], id_column: batch.column(id_column).take(pa.array(row + start))}))
                    if sum(map(len, held)) > max(1_000_000, 4 * kept):
                        held = [_best(pa.concat_tables(held), k, id_column)]
                        kept = len(held[0])
            if held:
                yield from _best(pa.concat_tables(held), k, id_column).to_batches()

        # A block's, so of bounded size; from Arrow, so that no Python worker is started for them.
        ids = spark.createDataFrame(pa.table({"query": range(len(own)), "query_id": [r.query_id for r in own]}), f"query long, query_id {query_type}")
        found = rows.mapInArrow(run, f"query long, score double, {id_column} {id_type}")
        parts.append(found.join(F.broadcast(ids), "query").select("query_id", id_column, "score"))
    if not parts:
        return spark.createDataFrame([], f"query_id {query_type}, {id_column} {id_type}, score double, rank int")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), id_column))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank).filter(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, np.nan)


def _dense_scores(block: np.ndarray, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    width = block.shape[1]
    fits = pc.equal(pc.list_value_length(column), width).to_numpy(zero_copy_only=False)
    for a in range(0, len(column), 1024):
        part, good = column.slice(a, 1024), np.flatnonzero(fits[a : a + 1024])
        out = np.full((len(part), len(block)), np.nan)
        if len(good):
            x = part.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            out[good] = _unit(x) @ block.T
        yield a, out


def dense_batch_topk(rows: DataFrame, queries: DataFrame, k: int, id_column: str = "point_id", vector: str = "dense", query_block: int = 4096) -> DataFrame:
    """query_id, id, score, rank for queries(query_id, dense), exactly: a task multiplies its rows' vectors with a block's matrix, slice by slice."""
    queries = queries.withColumnRenamed("dense", vector)
    rows = rows.select(id_column, vector).filter(F.col(vector).isNotNull())
    return _batch_topk(rows, queries, k, id_column, vector, query_block, lambda vectors: np.nan_to_num(_unit(np.array(vectors, float))), _dense_scores)


def sparse_product(query: Row, vector: Column) -> Column:
    """A row's product with one query's (indices, values), to twelve places; null where no term is shared. Linear in the row's terms."""
    order = np.argsort(np.array(query["indices"], np.int64), kind="stable")
    asked, weights = np.array(query["indices"], np.int64)[order], np.array(query["values"], float)[order]

    def made(rows: pa.Array) -> pa.Array:
        row, idx, val = _terms_of(rows)
        at = np.minimum(np.searchsorted(asked, idx), len(asked) - 1)
        shared = asked[at] == idx
        row = row[shared]
        total = np.round(np.bincount(row, val[shared] * weights[at[shared]], len(rows)), 12)
        return pa.array(total, mask=np.bincount(row, minlength=len(rows)) == 0)

    def run(rows: pa.Array) -> pa.Array:
        return pa.concat_arrays([made(rows.slice(a, len(part))) for a, part in slices(pc.struct_field(rows, "indices"), TERMS)])

    return F.arrow_udf(run, "double")(vector)


def sparse_topk(rows: DataFrame, query: Row, k: int, id_column: str = "point_id", vector: str = "sparse") -> DataFrame:
    """id, score: the k rows whose sparse vectors have the largest product with one query's (indices, values).

    Only rows that share a term take part. The product is made inside the row; only each task's k best move.
    """
    if not query["indices"]:
        return rows.select(id_column, F.lit(0.0).alias("score")).limit(0)
    return _largest(rows.select(id_column, sparse_product(query, F.col(vector)).alias("score")), k, id_column)


def _terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, idx, val) of a column of sparse vectors."""
    lists, values = pc.struct_field(column, "indices"), pc.struct_field(column, "values")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(column)), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), values.flatten().to_numpy(zero_copy_only=False)


def _largest(scored: DataFrame, k: int, id_column: str) -> DataFrame:
    """The k rows with the largest scores. Those without a score go last and then away: a filter before the limit would make Spark score rows twice."""
    return scored.orderBy(F.desc_nulls_last("score"), id_column).limit(k).filter(F.col("score").isNotNull())


class _Terms:
    """A block of sparse queries by term: the sorted terms, and for each the queries that have it, with their weights."""

    def __init__(self, vectors: list[Row]):
        idx = np.concatenate([np.zeros(0, np.int64), *[np.array(v["indices"], np.int64) for v in vectors]])
        order = np.argsort(idx, kind="stable")
        self.n = len(vectors)
        self.query = np.repeat(np.arange(len(vectors)), [len(v["indices"]) for v in vectors])[order]
        self.weight = np.concatenate([np.zeros(0), *[np.array(v["values"], float) for v in vectors]])[order]
        self.terms, self.begins, self.sizes = np.unique(idx[order], return_index=True, return_counts=True)


def _products(block: _Terms, row: np.ndarray, idx: np.ndarray, val: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Products of n rows by terms that they share with queries, in slices of about PRODUCTS at most."""
    at = np.minimum(np.searchsorted(block.terms, idx), len(block.terms) - 1)
    known = block.terms[at] == idx
    row, at, val = row[known], at[known], val[known]
    made = np.cumsum(np.bincount(row, block.sizes[at], n)) // PRODUCTS
    cuts = np.unique(np.concatenate([np.arange(0, n, 1024), np.flatnonzero(np.diff(made)) + 1, [n]]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        low, high = np.searchsorted(row, [a, b])
        sizes = block.sizes[at[low:high]]
        pair = np.repeat(block.begins[at[low:high]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        cell = np.repeat(row[low:high] - a, sizes) * block.n + block.query[pair]
        product = np.bincount(cell, np.repeat(val[low:high], sizes) * block.weight[pair], (b - a) * block.n)
        product[np.bincount(cell, minlength=(b - a) * block.n) == 0] = np.nan
        yield int(a), np.round(product, 12).reshape(-1, block.n)


def _sparse_scores(block: _Terms, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Of a batch of sparse vectors, or of lists of terms, which become such, a slice of bounded size at a time."""
    if not len(block.terms):
        return
    whole = pa.types.is_struct(column.type)
    for low, part in slices(pc.struct_field(column, "indices") if whole else column, TERMS):
        for a, product in _products(block, *(_terms_of(column.slice(low, len(part))) if whole else unit_terms(part)), len(part)):
            yield low + a, product


def sparse_batch_topk(rows: DataFrame, queries: DataFrame, k: int, id_column: str = "point_id", vector: str = "sparse", query_block: int = 1024, text: str | None = None) -> DataFrame:
    """query_id, id, score, rank for queries(query_id, sparse), exactly; only rows that share a term take part.

    text: rows hold texts, whose vectors (with_sparse) are made where they are scored: one Python worker a task, and no vectors that move between two.
    """
    if text is None:
        rows = rows.select(id_column, vector).filter(F.col(vector).isNotNull())
    else:
        rows = rows.filter(F.col(text).isNotNull()).select(id_column, tokens(F.col(text)).alias(vector))
    return _batch_topk(rows, queries.withColumnRenamed("sparse", vector), k, id_column, vector, query_block, _Terms, _sparse_scores)


def fuse(branches: list[DataFrame], k: int, id_column: str = "point_id", constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked branches (id, score), each of a bounded top-k: id, score."""
    rank = F.row_number().over(W.orderBy(F.desc("score"), id_column))
    ranked = [b.select(id_column, (1.0 / (constant + rank)).alias("part")) for b in branches]
    both = reduce(DataFrame.unionByName, ranked)
    return both.groupBy(id_column).agg(F.sum("part").alias("score")).orderBy(F.desc("score"), id_column).limit(k)


def hybrid_topk(dense: DataFrame, sparse: DataFrame, query: list[float], sparse_query: Row, k: int, id_column: str = "point_id", vector: str = "dense", sparse_vector: str = "sparse", constant: int = 60) -> DataFrame:
    """id, score: two branches of 2k, fused. Both inputs, which may be one table of points, must have been filtered before."""
    return fuse([dense_topk(dense, query, 2 * k, id_column, vector), sparse_topk(sparse, sparse_query, 2 * k, id_column, sparse_vector)], k, id_column, constant)


def post_filter(hits: DataFrame, payload: DataFrame, k: int, min_score: float = 0.0, min_content_length: int = 0, id_column: str = "point_id") -> DataFrame:
    """Of 2k hits, the first k that reach the score and length given; contents are joined to the hits only, late."""
    rows = payload.join(F.broadcast(hits), id_column)  # hits are a top-k, so of bounded size
    if min_score > 0:
        rows = rows.filter(F.col("score") >= min_score)
    if min_content_length > 0:
        rows = rows.filter(stripped_length(F.col("content")) >= min_content_length)
    return rows.orderBy(F.desc("score"), id_column).limit(k)

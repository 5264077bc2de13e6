"""Exact top-k search by inner product, a term at a time.

Vectors are sparse rows: a term is a component's number, its weight an integer. A block of queries goes to every
task; the task turns a slice of its rows into postings by term, and each term that a query holds adds its weighted
postings to dense arrays of scores. Selection by partition takes each query's k best of a slice, which are
merged with those before; tasks hand on k rows a query, and the last merge ranks them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import one_per_id, shared_folder, staged

#: Rows and queries whose dense scores are made at a time.
SLICE, LANES = 2048, 128
#: No score, and what loses every tie.
NONE, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def as_weights(x: np.ndarray) -> np.ndarray:
    """floor(64 * x) of doubles: 64-bit integers if all are below 2^31, else Python's."""
    scaled = np.floor(64.0 * np.asarray(x, np.float64))
    if not scaled.size or np.abs(scaled).max() < 2**31:
        return scaled.astype(np.int64)
    return np.array([int(v) for v in scaled], object)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of a column of vectors, without zero weights."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    weight = as_weights(column.flatten().to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(column)), sizes)
    term = np.arange(len(weight)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    some = np.flatnonzero(weight != 0)
    return row[some], term[some], weight[some]


def by_term(row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Postings: the rows that hold each term, and their weights."""
    if not len(term):
        return {}
    order = np.argsort(term, kind="stable")
    terms, begins = np.unique(term[order], return_index=True)
    return dict(zip(terms.tolist(), zip(np.split(row[order], begins[1:]), np.split(weight[order], begins[1:]), strict=True), strict=True))


@dataclass
class Queries:
    """A block of queries: ascending ids; for each lane, a run of `width` of them, per term the weights, 0 for queries without it."""

    ids: np.ndarray
    lanes: list[dict[int, np.ndarray]]
    largest: int  # sum of a query's absolute weights
    width: int

    @classmethod
    def of(cls, ids: list[int], vectors: list[list[float]], width: int = LANES) -> Queries:
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        row, term, weight = lists(pa.array([vectors[i] for i in order], pa.list_(pa.float64())))
        sums = [0] * len(ids)
        for r, w in zip(row.tolist(), weight.tolist(), strict=True):
            sums[r] += abs(w)
        lanes = []
        for a in range(0, len(ids), width):
            low, high = np.searchsorted(row, [a, a + width])
            dense = {}
            for t, (own, w) in by_term(row[low:high] - a, term[low:high], weight[low:high]).items():
                dense[t] = np.zeros(min(width, len(ids) - a), weight.dtype)
                dense[t][own] = w
            lanes.append(dense)
        return cls(np.array(ids, np.int64)[order], lanes, max(sums, default=0), width)


def accumulate(postings: dict[int, tuple[np.ndarray, np.ndarray]], lane: dict[int, np.ndarray], rows: int, queries: int, kind: type) -> np.ndarray:
    """(rows, queries): every term that both sides hold scatters its weighted postings into the scores."""
    scores = np.zeros((rows, queries), kind)
    for term, asked in lane.items():
        if term in postings:
            own, weight = postings[term]
            scores[own] += np.multiply.outer(weight.astype(kind), asked.astype(kind))
    return scores


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """(k, queries): the rows with each query's largest scores; of equal scores the first rows. Cells of NONE come last."""
    n = len(scores)
    take = min(k, n)
    top = int(np.abs(np.where(scores == NONE, 0, scores)).max(initial=0))
    if top < 2**62 // n - 1:
        # Place in the slice as last digits: no two keys are equal, so that a partition settles ties too.
        key = np.where(scores == NONE, NONE, scores * n + (n - 1 - np.arange(n))[:, None])
        return np.argpartition(key, n - take, axis=0)[n - take :]
    return np.argsort(np.where(scores == NONE, LAST, -np.maximum(scores, -LAST)), axis=0, kind="stable")[:take]


class Best:
    """Each query's k best rows so far."""

    def __init__(self, queries: int, k: int):
        self.scores, self.ids = np.full((queries, k), NONE), np.full((queries, k), LAST)

    def add(self, a: int, b: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (queries, n) of queries a to b."""
        scores, ids = np.concatenate([self.scores[a:b], scores], 1), np.concatenate([self.ids[a:b], np.where(scores == NONE, LAST, ids)], 1)
        # The complement turns the order round without overflow.
        order = np.lexsort((ids, ~scores), axis=1)[:, : self.scores.shape[1]]
        self.scores[a:b], self.ids[a:b] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def searched(batches: Iterator[pa.RecordBatch], asked: Queries, k: int, slice_rows: int = SLICE) -> Best:
    best = Best(len(asked.ids), k)
    for batch in batches:
        batch = batch.sort_by("vec_id")
        for a in range(0, batch.num_rows, slice_rows):
            part = batch.slice(a, slice_rows)
            ids = part.column("vec_id").to_numpy()
            row, term, weight = lists(part.column("embedding"))
            postings = by_term(row, term, weight)
            bound = asked.largest * max((abs(int(w)) for w in (weight.min(initial=0), weight.max(initial=0))), default=0)
            kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
            spot = np.searchsorted(asked.ids, ids)
            own = np.flatnonzero((spot < len(asked.ids)) & (asked.ids[np.minimum(spot, len(asked.ids) - 1)] == ids))
            for i, lane in enumerate(asked.lanes):
                low, high = i * asked.width, min((i + 1) * asked.width, len(asked.ids))
                scores = accumulate(postings, lane, len(ids), high - low, kind)
                scores = (np.clip(scores, -(2**63) + 1, 2**63 - 1) if kind is object else scores).astype(np.int64)
                mine = own[(spot[own] >= low) & (spot[own] < high)]
                scores[mine, spot[mine] - low] = NONE
                chosen = best_of(scores, k)
                best.add(low, high, np.take_along_axis(scores, chosen, 0).T, ids[chosen].T)
    return best


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: both not null, no null or non-finite component."""
    v = F.col("embedding")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding") if dict(vectors.dtypes)["embedding"] != "array<float>" else v).filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(good)


def in_blocks(queries: DataFrame, most: int, most_terms: int) -> tuple[DataFrame, int]:
    """queries(vec_id, embedding), one row per id, with `block`: each block has at most twice `most` rows and `most_terms` components, or is one query."""
    size = F.greatest(F.size("embedding"), F.lit(1)).cast("long")
    rows, terms = queries.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    n = max(1, -(-rows // most), -(-terms // most_terms))
    while True:
        parted = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
        # A row per block.
        worst = parted.groupBy("block").agg(F.count("*").alias("n"), F.sum(size).alias("t")).filter((F.col("n") > 1) & ((F.col("n") > 2 * most) | (F.col("t") > 2 * most_terms)))
        if n > 64 * rows or worst.isEmpty():
            return parted, n
        n *= 2


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 20, query_block: int = 4096, block_terms: int = 2**19, lanes: int = LANES, slice_rows: int = SLICE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of vectors(vec_id, embedding) with the largest integer inner products.

    Components count as floor(64 * x); a vector shorter than another counts as 0 beyond its end. Candidates are all
    rows but those with the query's id, repeated ones each; of queries that share an id the least counts. Ties go
    to the smaller vec_id. Rows whose id or vector is null, or with a null or non-finite component, take no part; an empty vector scores 0. A
    score beyond a long is the nearest long. No queries, or no candidates, give no rows; other columns are left out.

    Queries go out in blocks of bounded size; a block is one pass over the rows, in which every task keeps k rows a query.
    """
    spark = vectors.sparkSession
    rows = staged(usable(vectors), "exact-rows")
    asked, n = in_blocks(staged(one_per_id(usable(queries), "vec_id", "embedding"), "exact-queries"), query_block, block_terms)
    schema, path = "query_id long, vec_id long, score long", f"{shared_folder(spark)}/exact-found-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(f"{path}/block=-1")
    for number in range(n):
        own = asked.filter(F.col("block") == number).select("vec_id", "embedding").collect()
        if not own:
            continue
        sent = spark.sparkContext.broadcast(Queries.of([r.vec_id for r in own], [r.embedding for r in own], lanes))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best = searched(batches, sent.value, k, slice_rows)
            some = best.scores > NONE
            query = np.repeat(sent.value.ids, some.sum(1))
            yield from pa.table({"query_id": query, "vec_id": best.ids[some], "score": best.scores[some]}).to_batches(65_536)

        rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(f"{path}/block={number}")
        sent.unpersist()
    found = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_products(vectors: DataFrame, *, every: int = 20, k: int = 20) -> DataFrame:
    """The k best rows for every row whose vec_id is divisible by `every`; see search()."""
    return search(vectors, vectors.filter(F.col("vec_id") % every == 0), k=k)


ORACLE_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM pairs) WHERE rank <= 20"""

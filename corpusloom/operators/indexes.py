"""Indexes of points: inverted lists with block maxima for sparse vectors, coarse cells for dense ones.

Both are Parquet, laid out so that a search opens a small part of the files. Sparse search, and dense search with exact=True, give
what a scan gives: a bound tells which blocks or cells cannot reach the k-th score found so far. Filters and rows to leave out
count before the top-k.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.collection import Collection
from corpusloom.operators.retrieval import _terms_of, dense_topk, fuse, sparse_topk
from corpusloom.plans.log import Log
from corpusloom.plans.staging import clean_up, staged


def _top(scored: DataFrame, k: int, id_column: str) -> DataFrame:
    return scored.orderBy(F.desc("score"), id_column).limit(k)


def _lists(ids: pa.Array, vectors: pa.Array, number: int) -> pa.RecordBatch:
    """idx, range, top, posts of one range's points."""
    row, idx, val = _terms_of(vectors)
    place = np.empty(len(ids), np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    order = np.lexsort((place[row], idx))
    row, idx, val = row[order], idx[order], val[order]
    starts = np.flatnonzero(np.diff(idx, prepend=-1))
    posts = pa.StructArray.from_arrays([ids.take(pa.array(row)), pa.array(val)], names=["id", "val"])
    posts = pa.ListArray.from_arrays(pa.array(np.append(starts, len(idx)), pa.int32()), posts)
    tops = np.maximum.reduceat(val, starts) if len(starts) else val
    return pa.RecordBatch.from_arrays([pa.array(idx[starts], pa.int32()), pa.array(np.full(len(starts), number)), pa.array(tops), posts], names=["idx", "range", "top", "posts"])


def _packer(range_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lists of a task's sorted points(id, _vector), a range at a time; numbers of ranges begin with the task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            whole = len(held) - len(held) % range_rows
            for a in range(0, whole, range_rows):
                part = held.slice(a, range_rows).combine_chunks()
                yield _lists(part.column("id").chunk(0), part.column("_vector").chunk(0), number)
                number += 1
            # Copied, so that what is left doesn't keep the whole batch.
            held = held.slice(whole).combine_chunks() if whole < len(held) else None
        if held is not None:
            part = held.combine_chunks()
            yield _lists(part.column("id").chunk(0), part.column("_vector").chunk(0), number)

    return run


class SparseIndex:
    """Inverted lists in folder: bucket (of the term) / idx, range, top, posts.

    Points in order of `order` make ranges of so many, or fewer where a task of the sort ends; a list is cut by range, and `top` is its largest value there. A query reads its terms'
    buckets; ranges whose tops, weighted, cannot sum up to the k-th score are not unpacked.
    """

    def __init__(self, spark: SparkSession, folder: str, id_column: str = "point_id", buckets: int = 64):
        self.spark, self.folder, self.id, self.buckets = spark, folder.rstrip("/"), id_column, buckets

    def build(self, points: DataFrame, *, vector: str = "sparse", order: tuple[str, ...] = ("filepath", "chunk_index"), range_rows: int = 1024) -> SparseIndex:
        """Write the lists of points; neighbours in `order` should be alike, as chunks of a file are, so that their ranges differ."""
        keys = [*order, self.id] if self.id not in order else [*order]
        rows = points.select(self.id, *[c for c in order if c != self.id], F.col(vector).alias("_vector")).repartitionByRange(*keys).sortWithinPartitions(*keys)
        id_type = points.schema[self.id].dataType.simpleString()
        # Each task packs its own ranges, so that no posting is shuffled by itself.
        lists = rows.select(F.col(self.id).alias("id"), "_vector").mapInArrow(_packer(range_rows), f"idx int, range long, top double, posts array<struct<id:{id_type},val:double>>")
        lists = lists.withColumn("bucket", F.pmod("idx", F.lit(self.buckets)))
        # By ranges, so that a bucket with frequent terms is written by several tasks.
        lists.repartitionByRange("bucket", "idx", "range").sortWithinPartitions("bucket", "idx", "range").write.partitionBy("bucket").parquet(self.folder)
        return self

    def lists(self, terms: list[int]) -> DataFrame:
        """The lists of these terms; only their buckets' files are part of it."""
        there = set(Log(self.spark, self.folder).names(""))
        wanted = sorted(name for name in {f"bucket={t % self.buckets}" for t in terms} if name in there)
        if not wanted:
            return self.spark.createDataFrame([], f"idx int, range long, top double, posts array<struct<id:{self._id_type()},val:double>>")
        read = self.spark.read.option("basePath", self.folder).parquet(*[f"{self.folder}/{name}" for name in wanted])
        return read.filter(F.col("idx").isin(terms)).select("idx", "range", "top", "posts")

    def _id_type(self) -> str:
        return "string" if self.id == "point_id" else "bigint"

    def search(self, query: Row, k: int, *, only: DataFrame | None = None, without: DataFrame | None = None, first: int = 16) -> DataFrame:
        """id, score: the k points with the largest products, exactly. only, without: ids that may, or may not, take part."""
        weights = {int(i): float(v) for i, v in zip(query["indices"], query["values"], strict=True)}
        if not weights or k < 1:
            return self.spark.createDataFrame([], f"{self.id} {self._id_type()}, score double")
        lists = self.lists(list(weights))
        weight = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("idx"))
        # A row per range that has a term of the query.
        bounds = staged(lists.groupBy("range").agg(F.sum(F.greatest(weight, F.lit(0.0)) * F.col("top")).alias("bound")), "index-bounds")
        best = [r.range for r in bounds.orderBy(F.desc("bound"), "range").limit(first).collect()]

        def scored(some: DataFrame) -> DataFrame:
            products = some.select(F.explode("posts").alias("_p"), weight.alias("_w")).groupBy(F.col("_p.id").alias(self.id)).agg(F.round(F.sum(F.col("_p.val") * F.col("_w")), 12).alias("score"))
            if only is not None:
                products = products.join(only.select(self.id), self.id, "left_semi")
            return products if without is None else products.join(without.select(self.id), self.id, "left_anti")

        found = staged(_top(scored(lists.filter(F.col("range").isin(best))), k, self.id), "index-first")
        reached = [r.score for r in found.collect()]
        able = bounds.filter(~F.col("range").isin(best))
        if len(reached) >= k:
            able = able.filter(F.col("bound") >= reached[-1] - 1e-9)
        rest = scored(lists.join(able.select("range"), "range", "left_semi"))
        return _top(found.unionByName(_top(rest, k, self.id)), k, self.id)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _centres(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Directions by k-means on the unit sphere."""
    x, rng = _unit(x), np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        for c in np.unique(near):
            centres[c] = x[near == c].sum(0)
        centres = _unit(centres)
    return centres


class DenseIndex:
    """Points by the nearest of some coarse centres, in folder: `points` (by cell) and `cells` (cell, centre, n, least: the smallest cosine of a point to it)."""

    def __init__(self, spark: SparkSession, folder: str, id_column: str = "point_id"):
        self.spark, self.folder, self.id = spark, folder.rstrip("/"), id_column

    def build(self, points: DataFrame, *, vector: str = "dense", payload: tuple[str, ...] = (), cells: int = 256, fit_rows: int = 20_000) -> DenseIndex:
        """Write points by cell, with payload columns to filter on. Centres are fitted in one task, on fit_rows of them at most, chosen by a hash; every point with a direction is indexed."""
        length = F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        rows = points.select(self.id, F.col(vector).alias("vector"), *payload).filter(length > 0)
        by_hash = F.xxhash64(self.id)
        sample = rows.select("vector", by_hash.alias("_h"), self.id).orderBy("_h", self.id).limit(fit_rows).select("vector")

        def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = [b for b in batches if len(b)]
            if parts:
                found = _centres(np.array(pd.concat(parts)["vector"].tolist(), float), cells)
                yield pd.DataFrame({"cell": np.arange(len(found)), "centre": found.tolist()})

        centres = staged(sample.repartition(1).mapInPandas(fit, "cell int, centre array<double>"), "index-centres")
        matrix = np.array([r.centre for r in centres.orderBy("cell").collect()], float)  # at most `cells` rows
        sent = self.spark.sparkContext.broadcast(matrix)

        def assign(vectors: pa.Array) -> pa.Array:
            x = _unit(vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1))
            near = x @ sent.value.T
            cell = near.argmax(1)
            return pa.StructArray.from_arrays([pa.array(cell, pa.int32()), pa.array(near[np.arange(len(x)), cell])], names=["cell", "likeness"])

        placed = staged(rows.withColumn("_place", F.arrow_udf(assign, "struct<cell:int,likeness:double>")("vector")).select("*", "_place.*").drop("_place"), "index-placed")
        facts = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("likeness").alias("least"))
        centres.join(facts, "cell").coalesce(1).write.parquet(f"{self.folder}/cells")
        # By ranges, so that a cell with many points is written by several tasks.
        placed.drop("likeness").repartitionByRange("cell", by_hash).write.partitionBy("cell").parquet(f"{self.folder}/points")
        return self

    def cells(self) -> pd.DataFrame:
        return self.spark.read.parquet(f"{self.folder}/cells").toPandas()

    def rows(self, cells: list[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/points").parquet(*[f"{self.folder}/points/cell={c}" for c in cells])

    def search(self, query: list[float], k: int, *, share: float = 0.1, exact: bool = False, where: Column | None = None, without: DataFrame | None = None) -> DataFrame:
        """id, score: the k points most similar to the query.

        The nearest cells are read until they hold the given share of the points. exact: then all cells whose points could be nearer than the k-th found, as
        the angle between query and centre, less the cell's widest angle, tells. Where fewer than k points pass the filter, all other cells are read too.
        """
        cells, q = self.cells(), np.array(query, float)
        if not len(cells) or not np.linalg.norm(q):
            return self.spark.createDataFrame([], f"{self.id} {'string' if self.id == 'point_id' else 'bigint'}, score double")
        likeness = np.array(cells["centre"].tolist()) @ (q / np.linalg.norm(q))
        order = np.argsort(-likeness, kind="stable")
        held = np.cumsum(cells["n"].to_numpy()[order])
        near = order[: int(np.searchsorted(held, share * held[-1])) + 1]

        def best(some: np.ndarray) -> DataFrame:
            rows = self.rows(cells["cell"].to_numpy()[some].tolist())
            rows = rows if where is None else rows.filter(where)
            rows = rows if without is None else rows.join(without.select(self.id), self.id, "left_anti")
            return dense_topk(rows, query, k, self.id, "vector")

        found = staged(best(near), "index-near")
        scores = [r.score for r in found.collect()]
        rest = order[len(near) :]
        if len(scores) >= k:
            widest = np.arccos(np.clip(cells["least"].to_numpy(), -1, 1))
            nearest = np.maximum(0, np.arccos(np.clip(likeness, -1, 1)) - widest)
            rest = rest[np.cos(nearest)[rest] >= scores[-1] - 1e-6] if exact else rest[:0]
        return found if not len(rest) else _top(found.unionByName(best(rest)), k, self.id)


class CollectionIndex:
    """Both indexes of a collection, in its folder. Searches see the collection's last version: what was written since is scanned, what has gone is left out.

    When compaction has replaced the folders that were indexed, searches scan until build() is called again.
    """

    def __init__(self, collection: Collection):
        self.c, self.spark, self.folder = collection, collection.spark, f"{collection.folder}/index"
        self.log = Log(self.spark, self.folder)

    def build(self, **dense) -> int:
        """Index all live points; the number of the index. Older ones are removed."""
        state, name = self.c._state(), uuid.uuid4().hex
        points, version = self.c._live(state), (self.log.last() or {"version": -1})["version"] + 1
        with clean_up(self.spark):
            SparseIndex(self.spark, f"{self.folder}/sparse/{name}").build(points)
            DenseIndex(self.spark, f"{self.folder}/dense/{name}").build(points, payload=("filepath", "language", "is_test"), **dense)
            # Sorted, so that the ids of a file are found in few row groups.
            points.select("filepath", "point_id").repartitionByRange("filepath").sortWithinPartitions("filepath").write.parquet(f"{self.folder}/ids/{name}")
        self.log.commit({"version": version, "name": name, "data": state["data"], "dropped": state["dropped"]})
        self.log.keep_only({"sparse": {name}, "dense": {name}, "ids": {name}, "log": {Log.entry(version)}})
        return version

    def _since(self) -> tuple[str, DataFrame | None, DataFrame | None] | None:
        """(name, points written since, ids gone since); None where there is no index of the collection's folders."""
        state, entry = self.c._state(), self.log.last()
        if entry is None or not set(entry["data"]) <= set(state["data"]):
            return None
        new = [x for x in state["data"] if x not in entry["data"]]
        marks = [x for x in state["dropped"] if x not in entry["dropped"]]
        fresh = self.c._live({**state, "data": new}) if new else None
        gone = None
        if marks:
            from corpusloom.operators.collection import MARK

            marked = self.spark.read.schema(MARK).parquet(*[f"{self.c.folder}/dropped/{x}" for x in marks])
            ids = self.spark.read.parquet(f"{self.folder}/ids/{entry['name']}")
            gone = ids.join(marked.select("filepath").distinct(), "filepath", "left_semi").select("point_id").unionByName(marked.filter("point_id IS NOT NULL").select("point_id")).distinct()
        return entry["name"], fresh, gone

    def sparse(self, query: Row, k: int) -> DataFrame:
        if (since := self._since()) is None:
            return sparse_topk(self.c.read(), query, k)
        name, fresh, gone = since
        found = SparseIndex(self.spark, f"{self.folder}/sparse/{name}").search(query, k, without=gone)
        return found if fresh is None else _top(found.unionByName(sparse_topk(fresh, query, k)), k, "point_id")

    def dense(self, query: list[float], k: int, *, where: Column | None = None, **how) -> DataFrame:
        """where: a filter on filepath, language and is_test."""
        scan = lambda rows: dense_topk(rows if where is None else rows.filter(where), query, k)
        if (since := self._since()) is None:
            return scan(self.c.read())
        name, fresh, gone = since
        found = DenseIndex(self.spark, f"{self.folder}/dense/{name}").search(query, k, where=where, without=gone, **how)
        return found if fresh is None else _top(found.unionByName(scan(fresh)), k, "point_id")

    def hybrid(self, query: list[float], sparse_query: Row, k: int, constant: int = 60, **how) -> DataFrame:
        """id, score: two branches of 2k, fused; how as in DenseIndex.search()."""
        return fuse([self.dense(query, 2 * k, **how), self.sparse(sparse_query, 2 * k)], k, "point_id", constant)

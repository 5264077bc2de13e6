"""Collections of points: Parquet that is only ever added to, and a log of versions.

A collection's folder holds `meta` (dimension, vocabulary, buckets), `data`, `dropped` and `log`. A version adds one
folder of points, by bucket, and one of marks: "points of this file (or this id) from before this version are gone".
Both have a name of their own for each attempt, so that a write that broke stands in nobody's way. A version
counts once its entry stands in the log, which names all folders that readers need; an entry is created only if no
other writer has created it. What a batch writes is in proportion to what changed; compact() folds marks in.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions.paths import is_test, language, metadata_id, path_segments, point_id
from corpusloom.plans.log import Log
from corpusloom.plans.staging import staged

GIT = ["commit_hash", "commit_author", "commit_email", "commit_date", "commit_subject"]
POINT = (
    "point_id string, filepath string, content string, chunk_index int, language string, line_start int, line_end int, is_test boolean, "
    "symbols array<string>, type string, chunk_type string, path_segments map<string,string>, commit_hash string, commit_author string, commit_email string, "
    "commit_date string, commit_subject string, dense array<float>, sparse struct<indices:array<int>,values:array<double>>, bucket int"
)

MARK = "filepath string, point_id string, v int"
#: Bits of a data file's Bloom filter of the trigrams of its paths.
BITS = 8192


STATS = "file string, first string, last string, languages array<string>, tests array<boolean>, bits array<int>"


def points(chunks: DataFrame, root: str | None = None, buckets: int = 16) -> DataFrame:
    """Chunks as points, without vectors: ids, language, test flag, path segments, nullable commit columns. `type` is always code; the chunk's own is chunk_type."""
    path = F.col("filepath")
    rows = chunks.withColumns({c: F.lit(None).cast("string") for c in GIT if c not in chunks.columns}) if set(GIT) - set(chunks.columns) else chunks
    return rows.select(
        point_id(path, F.col("chunk_index")).alias("point_id"), "filepath", "content", "chunk_index", language(path).alias("language"), "line_start", "line_end",
        is_test(path).alias("is_test"), F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"), F.lit("code").alias("type"), F.col("type").alias("chunk_type"),
        path_segments(path, root).alias("path_segments"), *GIT, bucket_of(path, buckets).alias("bucket"),
    )


def trigram_bits(text: Column) -> Column:
    """The bits of a text's trigrams; none for texts of fewer than three characters."""
    n = F.length(text)
    places = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(3))), F.lit(BITS)).cast("int"))


def bucket_of(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


class Collection:
    """A named collection in a folder that all of the cluster shares."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder.rstrip("/"), Log(spark, folder)

    def exists(self) -> bool:
        return self._read("meta") is not None

    def _read(self, name: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def create(self, dim: int, vocabulary: int = 50_000, buckets: int = 16) -> Collection:
        """Make the collection, or open it if its dimension is the same; another one is an error."""
        if (meta := self._read("meta")) is not None:
            have = meta.first()
            if have.dim != dim:
                raise ValueError(f"the collection's vectors have {have.dim} dimensions, not {dim}")
            return self
        self.spark.createDataFrame([(dim, vocabulary, buckets)], "dim int, vocabulary int, buckets int").coalesce(1).write.parquet(f"{self.folder}/meta")
        self.log.commit({"version": 0, "data": [], "dropped": []})
        return self

    def meta(self):
        found = self._read("meta")
        if found is None:
            raise FileNotFoundError(f"no collection in {self.folder}")
        return found.first()

    def _state(self) -> dict:
        """The last entry of the log: version, and the folders of points and marks that it needs."""
        return self.log.last()

    @property
    def version(self) -> int:
        return self._state()["version"]

    # ------------------------------------------------------------ reading and writing

    def read(self) -> DataFrame:
        """All points; a filter on bucket reads the bucket's files only."""
        return self._live(self._state()).drop("a", "v")

    def read_where(self, file_filter: str | None = None, language: str | None = None, is_test: bool | None = None) -> DataFrame:
        """The points that retrieval.payload_filter() lets through; only data files that can hold such points are opened."""
        from corpusloom.operators.retrieval import payload_filter

        return self._live(self._state(), self.matching_files(file_filter, language, is_test)).drop("a", "v").filter(payload_filter(file_filter, language, is_test))

    def matching_files(self, file_filter: str | None = None, language: str | None = None, is_test: bool | None = None) -> list[str]:
        """The data files whose statistics don't rule out a match: languages, test files or others, and trigrams of paths."""
        names = [x for x in self._state()["data"] if x in set(self.log.names("stats"))]
        if not names:
            return []
        rows = self.spark.read.schema(STATS).parquet(*[f"{self.folder}/stats/{x}" for x in names])
        if language:
            rows = rows.filter(F.array_contains("languages", language))
        if is_test is not None:
            rows = rows.filter(F.array_contains("tests", is_test))
        if file_filter:
            bits = self.spark.range(1).select(trigram_bits(F.lit(file_filter)).alias("bits")).first().bits
            if bits:
                rows = rows.filter(F.size(F.array_except(F.array(*map(F.lit, sorted(set(bits)))), F.col("bits"))) == 0)
        return [r.file for r in rows.select("file").collect()]  # a part of the file list that Spark's reader holds anyway

    def _note_files(self, attempt: str) -> None:
        """Statistics of each file of a data folder, from its payload columns."""
        rows = self.spark.read.schema(f"{POINT}, v int").parquet(f"{self.folder}/data/a={attempt}")
        paths = rows.select(F.col("_metadata.file_path").alias("file"), "filepath", "language", "is_test").distinct()
        bits = paths.select("file", F.explode(trigram_bits(F.col("filepath"))).alias("bit")).groupBy("file").agg(F.collect_set("bit").alias("bits"))
        facts = paths.groupBy("file").agg(F.min("filepath").alias("first"), F.max("filepath").alias("last"), F.collect_set("language").alias("languages"), F.collect_set("is_test").alias("tests"))
        facts = facts.join(bits, "file", "left").select("file", "first", "last", "languages", "tests", F.coalesce("bits", F.array().cast("array<int>")).alias("bits"))
        facts.coalesce(4).write.parquet(f"{self.folder}/stats/{attempt}")

    def _live(self, state: dict, files: list[str] | None = None) -> DataFrame:
        """The live points of a state; of these data files only, if given."""
        schema = f"{POINT}, a string, v int"
        if not state["data"] or files == []:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.option("basePath", f"{self.folder}/data").schema(schema).parquet(*(files or [f"{self.folder}/data/a={x}" for x in state["data"]]))
        if not state["dropped"]:
            return rows
        # Marks since the last compaction; Spark broadcasts them only while they are few.
        marks = self.spark.read.schema(MARK).parquet(*[f"{self.folder}/dropped/{x}" for x in state["dropped"]])
        for key in ("filepath", "point_id"):
            last = marks.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max("v").alias("_v"))
            rows = rows.join(last, (F.col(key) == F.col("_key")) & (F.col("v") < F.col("_v")), "left_anti")
        return rows

    def apply(self, new: DataFrame | None = None, gone: DataFrame | None = None, mode: str = "replace") -> int:
        """One version with new points, and without the points of the files gone(filepath); returns its number.

        replace drops all old points of the files written, also those that a shorter file no longer has; compat only
        those with the ids written. Where nothing changes there is no new version.
        """
        state, attempt = self._state(), uuid.uuid4().hex
        version, marks, data = state["version"] + 1, [], list(state["data"])
        if new is not None:
            new = staged(new.select(*_fields()), "upsert")
            if not new.isEmpty():
                spread = F.pmod(F.xxhash64("filepath"), F.lit(4))  # a bucket's points in a few files, not in one from each task
                new.withColumn("a", F.lit(attempt)).withColumn("v", F.lit(version)).repartition(F.col("bucket"), spread).write.partitionBy("a", "v", "bucket").mode("append").parquet(f"{self.folder}/data")
                self._note_files(attempt)
                data.append(attempt)
                marks.append(new.select("filepath", F.lit(None).cast("string").alias("point_id")) if mode == "replace" else new.select(F.lit(None).cast("string").alias("filepath"), "point_id"))
        if gone is not None:
            marks.append(gone.select("filepath", F.lit(None).cast("string").alias("point_id")))
        if not marks:
            return state["version"]
        dropped = list(state["dropped"])
        if state["data"]:
            mark = staged(reduce(DataFrame.unionByName, marks).distinct().withColumn("v", F.lit(version)), "marks")
            if mark.isEmpty() and data == state["data"]:
                return state["version"]
            mark.coalesce(8).write.parquet(f"{self.folder}/dropped/{attempt}")
            dropped.append(attempt)
        elif data == state["data"]:
            return state["version"]
        self.log.commit({"version": version, "data": data, "dropped": dropped})
        return version

    def upsert(self, new: DataFrame, mode: str = "replace") -> int:
        """Write points by id; see apply()."""
        return self.apply(new, mode=mode)

    def delete_files(self, paths: DataFrame) -> int:
        """Drop the points of files that are gone."""
        return self.apply(gone=paths.select("filepath"))

    def compact(self) -> int:
        """Write the live points anew in one folder, without marks. Readers of older versions aren't disturbed."""
        state, attempt = self._state(), uuid.uuid4().hex
        if len(state["data"]) < 2 and not state["dropped"]:
            return state["version"]
        version = state["version"] + 1
        rows = self._live(state).withColumn("a", F.lit(attempt)).withColumn("v", F.lit(version))
        # Neighbouring paths share a file, so that statistics of paths rule many files out.
        rows.repartitionByRange(4 * self.meta().buckets, "bucket", "filepath").sortWithinPartitions("bucket", "filepath").write.partitionBy("a", "v", "bucket").mode("append").parquet(f"{self.folder}/data")
        there = f"a={attempt}" in self.log.names("data")
        if there:
            self._note_files(attempt)
        self.log.commit({"version": version, "data": [attempt] if there else [], "dropped": []})
        return version

    def vacuum(self) -> int:
        """Delete folders and log entries that the last version doesn't need, those of broken writes too; not while others read or write."""
        state = self._state()
        return self.log.keep_only({"data": {f"a={x}" for x in state["data"]}, "dropped": set(state["dropped"]), "stats": set(state["data"]), "log": {Log.entry(state["version"])}})

    def count(self) -> int:
        """Points, 0 for no collection."""
        return self.read().count() if self.exists() else 0

    def get(self, ids: list[str]) -> DataFrame:
        return self.read().filter(F.col("point_id").isin(ids))

    def mark_indexed(self, root: str, complete: bool = True) -> None:
        """Note that a workspace has been indexed. Kept apart from points, so that no search can return it."""
        row = self.spark.range(1).select(metadata_id(F.lit(root)).alias("id"), F.lit(root).alias("workspace_path"), F.lit(complete).alias("indexing_complete"), F.current_timestamp().alias("last_indexed_at"))
        row.write.mode("append").parquet(f"{self.folder}/status")

    def index_status(self, root: str) -> str:
        """Complete, In Progress / Stale, or Not Indexed."""
        found = self._read("status")
        last = None if found is None else found.filter(F.col("workspace_path") == root).orderBy(F.desc("last_indexed_at")).first()
        return "Not Indexed" if last is None else "Complete" if last.indexing_complete else "In Progress / Stale"

    def healthy(self) -> str:
        return "healthy" if self.exists() else "degraded"

    def drop(self) -> None:
        """Remove the collection's folder."""
        self.log.remove("")


def _fields() -> list[str]:
    """The names of POINT's columns."""
    return StructType.fromDDL(POINT).names


def stale_points(old: DataFrame, new: DataFrame) -> DataFrame:
    """Points of rewritten files that the new points don't replace: what compat leaves behind."""
    return old.join(new.select("filepath").distinct(), "filepath", "left_semi").join(new.select("point_id"), "point_id", "left_anti")


def merge_points(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert as an expression: new points, and old ones whose id they don't have."""
    return old.join(new.select("point_id"), "point_id", "left_anti").unionByName(new)

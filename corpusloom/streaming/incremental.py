"""Indexing as a stream: a feed of changed files, in batches of bounded size, updates collection, state and status."""

from __future__ import annotations

import threading
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import state as states
from corpusloom.operators.collection import Collection
from corpusloom.plans.indexing import index_changes
from corpusloom.plans.log import Log
from corpusloom.plans.staging import clean_up, staged
from corpusloom.sources import versions
from corpusloom.sources.codefs import ChangeFeed, contents


class StateTable:
    """file_state kept beside a collection, as a base and numbered changes; the log's last entry names the folders that count.

    What a batch writes is in proportion to its files. A base is sorted by path, so that a batch reads the rows of its own range of paths. A write that breaks
    before its entry is made leaves a folder that nobody reads, and that the next compaction removes.
    """

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = 20):
        self.spark, self.folder, self.log, self.compact_every = spark, folder.rstrip("/"), Log(spark, folder), compact_every

    def _last(self) -> dict:
        return self.log.last() or {"version": -1, "rows": []}

    def _live(self, names: list[str], wanted: F.Column | None = None) -> DataFrame:
        """The last row of each path, without those of files that are gone."""
        parts = [self.spark.read.schema(states.CHANGES).parquet(f"{self.folder}/rows/{name}").withColumn("_number", F.lit(i)) for i, name in enumerate(names)]
        if not parts:
            return states.empty(self.spark)
        rows = reduce(DataFrame.unionByName, parts)
        rows = rows if wanted is None else rows.filter(wanted)
        if len(parts) > 1:
            fields = F.struct(*[c for c in rows.columns if c not in ("path", "_number")])
            rows = rows.groupBy("path").agg(F.max_by(fields, F.col("_number")).alias("_last")).select("path", "_last.*")
        return rows.filter(~F.coalesce("gone", F.lit(False))).select(*[f.name for f in states.empty(self.spark).schema])

    def read(self) -> DataFrame:
        return self._live(self._last()["rows"])

    def of(self, paths: DataFrame) -> DataFrame:
        """The rows of paths(path) only."""
        low, high = paths.agg(F.min("path"), F.max("path")).first()
        if low is None:
            return states.empty(self.spark)
        return self._live(self._last()["rows"], F.col("path").between(low, high)).join(paths.select("path").distinct(), "path", "left_semi")

    def append(self, changes: DataFrame) -> int:
        """One more version, with changes(columns of the state, gone) by path; its number. A batch that runs again appends the same once more."""
        last, name = self._last(), uuid.uuid4().hex
        changes.coalesce(8).write.parquet(f"{self.folder}/rows/{name}")
        self.log.commit({"version": last["version"] + 1, "rows": [*last["rows"], name]})
        if len(last["rows"]) + 1 > self.compact_every:
            self.compact()
        return last["version"] + 1

    def compact(self) -> None:
        """Write all live rows as one base, sorted by path, and remove what no entry needs."""
        last, name = self._last(), uuid.uuid4().hex
        rows = self._live(last["rows"]).withColumn("gone", F.lit(False))
        rows.repartitionByRange("path").sortWithinPartitions("path").write.parquet(f"{self.folder}/rows/{name}")
        self.log.commit({"version": last["version"] + 1, "rows": [name]})
        self.log.keep_only({"rows": {name}, "log": {Log.entry(last["version"] + 1)}})


class IndexStream:
    """A running index: the streaming query, and with `watch` the thread that looks for changes."""

    def __init__(self, feed: ChangeFeed, start, seconds: float | None):
        self.feed, self.seconds, self._stopped, self.error = feed, seconds, threading.Event(), None
        feed.look()
        self.query = start()
        self._watcher = None
        if seconds is not None:
            self._watcher = threading.Thread(target=self._watch, daemon=True)
            self._watcher.start()

    def _watch(self) -> None:
        while not self._stopped.wait(self.seconds):
            try:
                self.feed.look()
            except Exception as e:  # what the storage refuses now it may give at the next look
                self.error = e

    def awaitTermination(self, timeout: float | None = None):
        return self.query.awaitTermination() if timeout is None else self.query.awaitTermination(int(timeout))

    @property
    def isActive(self) -> bool:
        return self.query.isActive

    def stop(self) -> None:
        self._stopped.set()
        if self._watcher is not None:
            self._watcher.join()
        self.query.stop()


def index_stream(spark: SparkSession, root: str, collection: Collection, state: StateTable, provider, checkpoint: str, *, watch: bool = False, strategy: str = "ast", seconds: float = 5, git: bool = False, only_tracked: bool = False, compact_every: int = 100, max_files: int = 1000, max_bytes: int = 256 * 2**20, **window: int) -> IndexStream:
    """Index root in batches of at most max_files files and max_bytes bytes; without `watch` it ends when all files seen at the start are done. stop() ends it.

    A stream that was stopped or killed goes on where it was: its place in the feed is in the checkpoint. git fills the commit
    columns, from new commits alone; only_tracked leaves out files that version control doesn't know. The collection is compacted after every
    compact_every batches.
    """
    feed = ChangeFeed(spark, root, f"{checkpoint.rstrip('/')}-feed", max_files=max_files, max_bytes=max_bytes)
    commits = versions.CommitTable(spark, f"{checkpoint.rstrip('/')}-commits") if git else None

    def batch(rows: DataFrame, number: int) -> None:
        with clean_up(spark):
            changes = staged(rows.select("path", "mtime_ns", "change"), "batch")
            index_batch(spark, changes, root, collection, state, provider, commits=commits, only_tracked=only_tracked, strategy=strategy, **window)
        if number % compact_every == compact_every - 1:
            collection.compact()

    def start():
        writer = feed.stream().writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=f"{seconds} seconds") if watch else writer.trigger(availableNow=True)).start()

    return IndexStream(feed, start, seconds if watch else None)


def index_batch(spark: SparkSession, changes: DataFrame, root: str, collection: Collection, state: StateTable, provider, *, commits: versions.CommitTable | None = None, only_tracked: bool = False, strategy: str = "ast", **window: int) -> None:
    """Bring collection and state up to date with changes(path, mtime_ns, change), written before."""
    latest = None
    if commits is not None:
        commits.update(root)
        latest = commits.of(changes)
    tracked = versions.tracked_files(spark, root) if only_tracked else None
    width = max(1, min(4 * spark.sparkContext.defaultParallelism, changes.count()))
    read = staged(contents(changes.repartition(width, "path"), root), "contents")
    state.append(index_changes(read, collection, state.of(changes), provider, root=root, latest=latest, tracked=tracked, strategy=strategy, **window))


def index_due(spark: SparkSession, root: str, collection: Collection, state: StateTable, provider, *, strategy: str = "ast", commits: versions.CommitTable | None = None, only_tracked: bool = False, **window: int) -> None:
    """Try files again that could not be embedded and have waited long enough; a stream sees a file only when it changes."""
    from corpusloom.sources.codefs import listing

    with clean_up(spark):
        due = state.read().filter("embed_retries > 0 AND NOT coalesce(failed, false)").select("path")
        changes = staged(listing(spark, root).join(due, "path", "left_semi").select("path", "mtime_ns", F.lit("upsert").alias("change")), "due")
        if not changes.isEmpty():
            index_batch(spark, changes, root, collection, state, provider, commits=commits, only_tracked=only_tracked, strategy=strategy, **window)

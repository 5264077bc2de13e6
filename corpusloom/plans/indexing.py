"""The indexing plan: files to points with vectors, and what state says about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.chunking import chunk
from corpusloom.operators.collection import Collection, points
from corpusloom.operators.state import after_failure, after_success, should_reindex
from corpusloom.operators.vectors import embed, with_sparse
from corpusloom.plans.staging import staged
from corpusloom.sources.readers import extracted
from corpusloom.sources.versions import only_tracked, with_commits


def to_points(files: DataFrame, provider, *, strategy: str = "ast", root: str | None = None, buckets: int = 16, batch: int = 100, vocabulary: int | None = 50_000, keep_going: bool = False, **window: int) -> DataFrame:
    """files(filepath, content as text, commit columns if any) to rows of a collection, without a shuffle; keep_going as in embed()."""
    rows = points(chunk(files, strategy, **window), root, buckets)
    rows = embed(rows, provider, batch=batch, keep_going=keep_going)
    if vocabulary:
        return with_sparse(rows, vocabulary=vocabulary)
    return rows.withColumn("sparse", F.struct(F.array().cast("array<int>").alias("indices"), F.array().cast("array<double>").alias("values")))


def index_changes(changes: DataFrame, collection: Collection, state: DataFrame, provider, *, root: str, latest: DataFrame | None = None, tracked: DataFrame | None = None, strategy: str = "ast", **window: int) -> DataFrame:
    """Bring a collection up to date with changed files (rows of codefs.SCHEMA); returns what changes in the state (state.CHANGES).

    state: rows of these files at least. Checksums are taken after the modification time has ruled files out. All changes are one version of the
    collection, and come before the state: if a batch runs again after a failure, the same ids are written again. A file that the
    provider cannot embed keeps its old points; its state counts the failure, and the other files go on. latest: their last
    commits (versions.latest_commits); tracked: the only files to take (versions.tracked_files).
    """
    gone = changes.filter("change = 'delete'").select(F.col("path").alias("filepath"))
    same = state.select("path", F.col("last_modified").alias("mtime"))
    files = only_tracked(changes.filter("change <> 'delete'"), tracked).join(same, ["path", "mtime"], "left_anti").withColumn("sha256", F.sha2("content", 256))
    todo = staged(should_reindex(files, state).filter("reindex").drop("reindex"), "todo")
    text = todo.select(F.col("path").alias("filepath"), extracted().alias("content")).filter(F.col("content").isNotNull())
    # Written, so that documents are extracted once, however often the plan below reads them.
    text = staged(text if latest is None else with_commits(text, latest), "texts")
    made = staged(to_points(text, provider, strategy=strategy, root=root, buckets=collection.meta().buckets, keep_going=True, **window), "points")
    failed = staged(made.filter("dense IS NULL").select("filepath").distinct(), "failed")
    new = made.join(failed, "filepath", "left_anti")
    tried = todo.join(failed.withColumnRenamed("filepath", "path"), "path", "left_anti")
    emptied = tried.select(F.col("path").alias("filepath")).join(new.select("filepath").distinct(), "filepath", "left_anti")
    collection.apply(new, gone.unionByName(emptied))
    counts = new.groupBy(F.col("filepath").alias("path")).agg(F.count("*").alias("chunk_count"))
    done = tried.select("path", "mtime", "sha256").join(counts, "path", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    own = state.join(failed.withColumnRenamed("filepath", "path"), "path", "left_semi")
    counted = after_failure(own, failed.withColumnRenamed("filepath", "path"), F.unix_timestamp(F.current_timestamp()).cast("double"))
    made = after_success(counted, done, F.current_timestamp()).withColumn("gone", F.lit(False))
    lost = gone.select(F.col("filepath").alias("path")).join(done.select("path"), "path", "left_anti")
    lost = lost.select("path", *[F.lit(None).cast(f.dataType).alias(f.name) for f in made.schema if f.name not in ("path", "gone")], F.lit(True).alias("gone"))
    out = staged(made.unionByName(lost), "state")
    collection.mark_indexed(root)
    return out

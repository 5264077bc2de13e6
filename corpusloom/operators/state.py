"""Which files need indexing: state per path, as tables.

file_state: path, last_modified, checksum, chunk_count, indexed_at, embed_retries, last_embed_attempt, failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, last_modified timestamp, checksum string, chunk_count int, indexed_at timestamp, embed_retries int, last_embed_attempt double, failed boolean"
#: What a batch adds to a state: rows that replace a path's row, or say that its file is gone.
CHANGES = f"{SCHEMA}, gone boolean"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def stale(now: Column) -> Column:
    """For files (mtime, sha256) left-joined with their state: whether to index. Failed files never are; after a failure a file waits min(2^n, 60) minutes."""
    cooling = (F.coalesce("embed_retries", F.lit(0)) > 0) & (now - F.coalesce("last_embed_attempt", F.lit(0.0)) < F.least(F.pow(F.lit(2.0), F.col("embed_retries")), F.lit(60.0)) * 60)
    return (
        F.when(F.col("known").isNull(), True)
        .when(F.coalesce("failed", F.lit(False)), False)
        .when(cooling, False)
        .when(F.col("last_modified").eqNullSafe(F.col("mtime")), False)
        .otherwise(~F.col("checksum").eqNullSafe(F.col("sha256")))
    )


def should_reindex(files: DataFrame, state: DataFrame, now: Column | None = None) -> DataFrame:
    """files(path, mtime, sha256, ...) with `reindex`."""
    now = F.unix_timestamp(F.current_timestamp()).cast("double") if now is None else now
    old = state.select("path", "last_modified", "checksum", "embed_retries", "last_embed_attempt", "failed").withColumn("known", F.lit(True))
    rows = files.join(old, "path", "left")
    return rows.withColumn("reindex", stale(now)).drop("last_modified", "checksum", "embed_retries", "last_embed_attempt", "failed", "known")


def after_failure(state: DataFrame, failed_paths: DataFrame, now: Column, most: int = 5) -> DataFrame:
    """State with one more failed attempt for each path given; over `most` of them the file has failed for good."""
    mark = failed_paths.select("path").distinct().withColumn("_hit", F.lit(True))
    rows = state.join(mark, "path", "full_outer")
    retries = F.coalesce("embed_retries", F.lit(0)) + 1
    hit = F.coalesce("_hit", F.lit(False))
    return rows.select(
        "path", "last_modified", "checksum", "chunk_count", "indexed_at",
        F.when(hit, retries).otherwise(F.col("embed_retries")).cast("int").alias("embed_retries"),
        F.when(hit, now.cast("double")).otherwise(F.col("last_embed_attempt")).alias("last_embed_attempt"),
        F.when(hit & (retries > most), True).otherwise(F.col("failed")).alias("failed"),
    )


def after_success(state: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """State with fresh entries for done(path, mtime, sha256, chunk_count), without marks of failure; files without chunks get one too."""
    fresh = done.select("path", F.col("mtime").alias("last_modified"), F.col("sha256").alias("checksum"), F.col("chunk_count").cast("int").alias("chunk_count"), now.cast("timestamp").alias("indexed_at"), F.lit(None).cast("int").alias("embed_retries"), F.lit(None).cast("double").alias("last_embed_attempt"), F.lit(None).cast("boolean").alias("failed"))
    return state.join(done.select("path"), "path", "left_anti").unionByName(fresh)

"""Version control: tracked files, and each file's last commit, kept up to date by new commits alone."""

from __future__ import annotations

import itertools
import subprocess
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.log import Log
from corpusloom.plans.staging import clean_up, staged

COMMIT = "path string, commit_hash string, commit_author string, commit_email string, commit_date string, commit_subject string, pos long"


def _git(root: str, *arguments: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, errors="replace", timeout=600)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def is_repository(root: str) -> bool:
    return _git(root, "rev-parse", "--is-inside-work-tree") is not None


def _absolute(root: str) -> str:
    import os

    return os.path.abspath(root)


def _told(spark: SparkSession, root: str, arguments: list[str], end: bytes, rows: Callable[[Iterator[bytes]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of what git writes, made in one task that reads it piece by piece (pieces end with `end`), and written to the shared folder; root is a path that all executors see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(b.num_rows for b in batches):
            with subprocess.Popen(["git", "-C", root, *arguments], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as git:
                found = rows(_pieces(git.stdout, end))
                while part := list(itertools.islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], names=names)
            if git.returncode:
                raise RuntimeError(f"git {arguments[0]} failed in {root}")

    names = [f.split()[0] for f in schema.split(", ")]
    return staged(spark.range(1).coalesce(1).mapInArrow(run, schema), "git")


def _pieces(stream: BinaryIO, end: bytes) -> Iterator[bytes]:
    held = b""
    while block := stream.read(65_536):
        *whole, held = (held + block).split(end)
        yield from whole
    yield held


def tracked_files(spark: SparkSession, root: str) -> DataFrame | None:
    """path of the tracked files at or below root, absolute, or None outside a repository, where every file counts as tracked."""
    root = _absolute(root)
    if not is_repository(root):
        return None
    return _told(spark, root, ["ls-files", "-z"], b"\0", lambda pieces: ((f"{root}/{p.decode('utf-8', 'replace')}",) for p in pieces if p), "path string")


def only_tracked(files: DataFrame, tracked: DataFrame | None) -> DataFrame:
    return files if tracked is None else files.join(tracked, "path", "left_semi")


def _entry_rows(entry: str, root: str, pos: int) -> list[tuple]:
    """Rows of COMMIT of one commit: five header fields, then its files."""
    head, _, names = entry.partition("\x1d")
    fields = head.split("\x1f")
    return [(f"{root}/{n.strip(chr(10))}", *fields, pos) for n in names.split("\0") if n.strip("\n")] if len(fields) == 5 else []


def parse_log(text: str, root: str) -> list[tuple]:
    """Rows of COMMIT from `git log --name-only -z` with five header fields; pos counts commits, newest first."""
    return [row for pos, entry in enumerate(text.split("\x1e")[1:]) for row in _entry_rows(entry, root, pos)]


def commit_log(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """Rows of COMMIT of the commits that HEAD has (and `since` has not), for files at or below root; paths are absolute."""
    root = _absolute(root)
    if _git(root, "rev-parse", "--verify", "HEAD") is None:
        return spark.createDataFrame([], COMMIT)
    arguments = ["log", "--relative", "--name-only", "-z", "--date=iso", "--format=%x1e%H%x1f%an%x1f%ae%x1f%ad%x1f%s%x1d", f"{since}..HEAD" if since else "HEAD"]
    rows = lambda pieces: (row for pos, p in enumerate(pieces) for row in _entry_rows(p.decode("utf-8", "replace"), root, pos))
    return _told(spark, root, arguments, b"\x1e", rows, COMMIT)


def latest_commits(log: DataFrame) -> DataFrame:
    """Each path's newest commit."""
    fields = F.struct("commit_hash", "commit_author", "commit_email", "commit_date", "commit_subject")
    return log.groupBy("path").agg(F.min_by(fields, F.col("pos")).alias("c")).select("path", "c.*")


def with_commits(files: DataFrame, latest: DataFrame) -> DataFrame:
    """files(filepath, ...) with its last commit's columns, as latest_commits() has them, null where there is none."""
    return files.join(latest.withColumnRenamed("path", "filepath"), "filepath", "left")


class CommitTable:
    """Each file's last commit, kept in a shared folder and brought up to date by new commits alone.

    `rows` holds a folder for each update that found new commits, named in the log with the commit it ends at. A history that was
    rewritten, so that this commit is no ancestor any more, is read anew.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder.rstrip("/"), Log(spark, folder)

    def update(self, root: str, most_folders: int = 50) -> int:
        """Add what root's repository has committed since the last update; how many commits of files were new."""
        root, last = _absolute(root), self.log.last() or {"version": -1, "rows": [], "head": None}
        head = (_git(root, "rev-parse", "--verify", "HEAD") or "").strip()
        if not head or head == last["head"]:
            return 0
        since = last["head"] if last["head"] and _git(root, "merge-base", "--is-ancestor", last["head"], head) is not None else None
        with clean_up(self.spark):
            new = commit_log(self.spark, root, since)
            n, name, kept = new.count(), uuid.uuid4().hex, last["rows"] if since else []
            if len(kept) >= most_folders:  # fold all into one
                latest_commits(self._ranked(kept)).withColumn("pos", F.lit(2**40).cast("long")).unionByName(new).write.parquet(f"{self.folder}/rows/{name}")
                kept = [name]
            elif n or not kept:
                new.write.parquet(f"{self.folder}/rows/{name}")
                kept = [*kept, name]
            self.log.commit({"version": last["version"] + 1, "rows": kept, "head": head})
            self.log.keep_only({"rows": set(kept), "log": {Log.entry(last["version"] + 1)}})
        return n

    def _ranked(self, names: list[str]) -> DataFrame:
        """Rows of all updates, later ones before earlier ones."""
        parts = [self.spark.read.schema(COMMIT).parquet(f"{self.folder}/rows/{name}").withColumn("pos", F.col("pos") - F.lit(2**41) * i) for i, name in enumerate(names)]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], COMMIT)

    def latest(self) -> DataFrame:
        """Each path's newest commit."""
        return latest_commits(self._ranked((self.log.last() or {"rows": []})["rows"]))

    def of(self, paths: DataFrame) -> DataFrame:
        """The newest commits of paths(path) only: a batch's files, whose range of paths prunes what is read."""
        low, high = paths.agg(F.min("path"), F.max("path")).first()
        if low is None:
            return self.latest().limit(0)
        rows = self._ranked((self.log.last() or {"rows": []})["rows"]).filter(F.col("path").between(low, high))
        return latest_commits(rows.join(paths.select("path").distinct(), "path", "left_semi"))


def history_text(path: str, latest: DataFrame) -> str:
    """The last commit of a file, as latest_commits() has it, as markdown."""
    row = latest.filter(F.col("path") == path).first()
    if row is None:
        return f"No git history found for: {path}\n(File may be untracked or has no commits.)"
    return (
        f"# Git History: {path.rsplit('/', 1)[-1]}\n- **Commit**: `{row.commit_hash}`\n- **Author**: {row.commit_author} <{row.commit_email}>\n"
        f"- **Date**: {row.commit_date}\n- **Subject**: {row.commit_subject}\n"
    )

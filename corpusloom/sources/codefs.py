"""Files below a directory: a listing made by tasks, their contents, and a feed of what has changed.

Unlike Spark's file source this returns names that begin with an underscore, and empty files; hidden and excluded
directories are pruned before they are entered. Directories are listed, and contents read, in tasks, through
Arrow's file systems: a root is a path that all executors see, or a URI such as s3://bucket/folder.

The feed is a folder of Parquet: the last snapshot of the listing, and change files of bounded size, which a stream
takes a file at a time (Spark's own file source keeps its place). No list of paths passes the driver.
"""

from __future__ import annotations

import fnmatch
import os
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.functions.paths import DOCUMENT_SUFFIXES, EXCLUDED_DIRS, NAMES, TEXT_SUFFIXES
from corpusloom.plans.log import Log
from corpusloom.plans.order import positioned
from corpusloom.plans.staging import clean_up, staged

SCHEMA = "path string, name string, suffix string, mtime timestamp, length long, content binary, change string"
LISTED = "path string, mtime_ns long, length long"
CHANGE = "path string, mtime_ns long, length long, change string"


def ignore_rules(lines: list[str]) -> list[tuple[bool, re.Pattern]]:
    """Patterns of one ignore file as (ignore?, expression on relative paths); later ones win."""
    rules = []
    for line in lines:
        line = line.rstrip("\n")
        if not line.strip() or line.startswith("#"):
            continue
        keep, pattern = line.startswith("!"), line.lstrip("!").rstrip()
        anchored = "/" in pattern.rstrip("/")
        inner = pattern.strip("/")
        parts = [r"(?:.*/)?" if p == "**" else fnmatch.translate(p)[4:-3].replace(".*", "[^/]*") + "/" if not p.endswith("\\") else p for p in inner.split("/")]
        body = "".join(parts).rstrip("/")
        rules.append((not keep, re.compile(("" if anchored else r"(?:.*/)?") + body + (r"/.*" if pattern.endswith("/") else r"(?:/.*)?") + r"\Z", re.S)))
    return rules


def ignored(path: str, rules: list[tuple[bool, re.Pattern]]) -> bool:
    out = False
    for ignore, pattern in rules:
        if pattern.match(path):
            out = ignore
    return out


class Root:
    """A directory on some file system, and the rules of the ignore file in it."""

    def __init__(self, root: str, gitignore: bool = True):
        self.root = root if "://" in root else os.path.abspath(root)
        self.rules: list[tuple[bool, re.Pattern]] = []
        fs, path = self.opened()
        if gitignore and fs.get_file_info(f"{path}/.gitignore").type == pafs.FileType.File:
            with fs.open_input_stream(f"{path}/.gitignore") as f:
                self.rules = ignore_rules(f.read().decode("utf-8", "replace").splitlines(keepends=True))

    def opened(self) -> tuple[pafs.FileSystem, str]:
        fs, path = pafs.FileSystem.from_uri(self.root) if "://" in self.root else (pafs.LocalFileSystem(), self.root)
        return fs, path.rstrip("/")

    def entries(self, folder: str) -> tuple[list[tuple[str, int, int]], list[str]]:
        """Supported files (path, mtime_ns, length) and directories to enter, of one directory; nothing of one that has gone."""
        fs, top = self.opened()
        try:
            found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        except OSError:
            return [], []
        files, dirs = [], []
        for e in sorted(found, key=lambda e: e.path):
            name, inside = e.base_name, e.path[len(top) + 1 :]
            if e.type == pafs.FileType.Directory:
                if not name.startswith(".") and name not in EXCLUDED_DIRS and not ignored(f"{inside}/", self.rules):
                    dirs.append(e.path)
            elif e.type == pafs.FileType.File and (os.path.splitext(name)[1] in (*TEXT_SUFFIXES, *DOCUMENT_SUFFIXES) or name in NAMES) and not ignored(inside, self.rules):
                files.append((e.path, e.mtime_ns or 0, e.size))
        return files, dirs

    def walk(self, folders: list[str], most: int | None = None) -> Iterator[tuple[list[tuple[str, int, int]], list[str]]]:
        """(files, ()) of directories and those below them; once `most` entries are listed, the directories not entered yet, as (none, directories)."""
        todo, seen = list(reversed(folders)), 0
        while todo:
            if most is not None and seen >= most:
                yield [], todo
                return
            files, dirs = self.entries(todo.pop())
            seen += len(files) + len(dirs) + 1
            todo += reversed(dirs)
            yield files, []


def listing(spark: SparkSession, root: str, *, gitignore: bool = True, most: int = 20_000) -> DataFrame:
    """path, mtime_ns, length of the supported files below root, written to the shared folder.

    A task lists directories and what is below them, but hands on what it hasn't entered after `most` entries; those are dealt out again, so that
    a large subtree spreads, and a small tree is one job.
    """
    at = Root(root, gitignore)
    schema = pa.schema([("path", pa.string()), ("mtime_ns", pa.int64()), ("length", pa.int64()), ("folder", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for files, dirs in at.walk(batch.column("folder").to_pylist(), most):
                rows = [(*f, None) for f in files] + [(None, None, None, d) for d in dirs]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    todo, parts = spark.createDataFrame([(at.opened()[1],)], "folder string"), []
    while True:
        found = staged(todo.mapInArrow(run, f"{LISTED}, folder string"), "listing")
        parts.append(found.filter("path IS NOT NULL").drop("folder"))
        todo = found.filter("folder IS NOT NULL").select("folder")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        todo = todo.repartition(4 * spark.sparkContext.defaultParallelism)


def contents(changes: DataFrame, root: str) -> DataFrame:
    """Rows of SCHEMA for changes(path, mtime_ns, change), read in tasks, a file at a time; a file that cannot be read any more counts as deleted."""
    at = Root(root, gitignore=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = at.opened()
        schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("suffix", pa.string()), ("mtime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary()), ("change", pa.string())])
        for batch in batches:
            for path, mtime, change in zip(*[batch.column(c).to_pylist() for c in ("path", "mtime_ns", "change")], strict=True):
                row = _row(fs, path, mtime, change)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    return changes.select("path", "mtime_ns", "change").mapInArrow(run, SCHEMA)


def _row(fs: pafs.FileSystem, path: str, mtime_ns: int | None, change: str) -> tuple:
    data = None
    if change != "delete":
        try:
            with fs.open_input_stream(path) as f:
                data = f.read()
        except OSError:
            change = "delete"
    name = os.path.basename(path)
    return (path, name, os.path.splitext(name)[1], None if mtime_ns is None else mtime_ns // 1000, None if data is None else len(data), data, change)


def files(spark: SparkSession, root: str, *, gitignore: bool = True) -> DataFrame:
    """Rows of SCHEMA for all supported files below root."""
    return contents(listing(spark, root, gitignore=gitignore).withColumn("change", F.lit("upsert")).repartition(4 * spark.sparkContext.defaultParallelism), root)


class ChangeFeed:
    """What has changed below root since the last look, as change files of bounded size in a shared folder.

    folder: `snapshots`, `changes` and `log`, whose last entry names the snapshot that counts. A look that breaks before its entry is
    made is repeated by the next one; its change files may then come twice, which does no harm to an index.
    """

    def __init__(self, spark: SparkSession, root: str, folder: str, *, gitignore: bool = True, max_files: int = 1000, max_bytes: int = 256 * 2**20):
        self.spark, self.root, self.folder, self.gitignore = spark, root, folder.rstrip("/"), gitignore
        self.max_files, self.max_bytes, self.log = max_files, max_bytes, Log(spark, folder)

    def snapshot(self) -> DataFrame:
        """The listing as of the last look."""
        last = self.log.last()
        return self.spark.read.schema(LISTED).parquet(f"{self.folder}/snapshots/{last['name']}") if last else self.spark.createDataFrame([], LISTED)

    def look(self) -> int:
        """List the tree and write what differs from the last snapshot; how many files differ."""
        with clean_up(self.spark):
            last, old = self.log.last(), self.snapshot()
            new = listing(self.spark, self.root, gitignore=self.gitignore)
            changed = new.join(old, ["path", "mtime_ns", "length"], "left_anti").withColumn("change", F.lit("upsert"))
            gone = old.join(new, "path", "left_anti").withColumn("change", F.lit("delete"))
            changes = staged(numbered(changed.unionByName(gone), self.max_files, self.max_bytes), "changes")
            n, groups = changes.agg(F.count("*"), F.countDistinct("part")).first()
            if last is not None and not n:
                return 0
            version, name = (last["version"] + 1 if last else 0), uuid.uuid4().hex
            # A file for each part: what a stream takes at a time.
            changes.repartition(max(1, groups), "part").write.partitionBy("part").mode("append").parquet(f"{self.folder}/changes/look={name}")
            new.write.parquet(f"{self.folder}/snapshots/{name}")
            self.log.commit({"version": version, "name": name})
            self.log.keep_only({"snapshots": {name}, "log": {Log.entry(version)}})
            return n

    def stream(self) -> DataFrame:
        """A stream of CHANGE, a change file a batch; files that are done with are deleted."""
        return self.spark.readStream.schema(f"{CHANGE}, look string, part long").option("maxFilesPerTrigger", 1).option("cleanSource", "delete").parquet(f"{self.folder}/changes").drop("look", "part")


def numbered(changes: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """changes in order of the path, in parts of at most max_files rows and max_bytes (or one file)."""
    rows = positioned(changes, ["path"], {"_bytes": F.coalesce("length", F.lit(0))})
    # Within a part neither the count nor the bytes before a row pass a multiple of their bound.
    part = F.floor(F.col("_at") / max_files) + F.floor(F.col("_bytes") / max_bytes)
    return rows.select("path", "mtime_ns", "length", "change", part.cast("long").alias("part"))


class _Folders(InputPartition):
    def __init__(self, folders: list[str], files: list[tuple[str, int, int]]):
        self.folders, self.files = folders, files


class _Reader(DataSourceReader):
    """A partition for each directory in the root, walked by its task, and one for the root's own files."""

    def __init__(self, options):
        self.at = Root(options["path"], options.get("gitignore", "true").lower() == "true")

    def partitions(self) -> list[_Folders]:
        files, dirs = self.at.entries(self.at.opened()[1])
        return [_Folders([], files), *(_Folders([d], []) for d in dirs)]

    def read(self, partition: _Folders) -> Iterator[tuple]:
        import datetime

        fs, _ = self.at.opened()
        for found in (partition.files, *(files for files, _ in self.at.walk(partition.folders))):
            for path, mtime, _ in found:
                row = list(_row(fs, path, mtime, "upsert"))
                row[3] = datetime.datetime.fromtimestamp(row[3] / 1e6)
                yield tuple(row)


class CodeFiles(DataSource):
    """Files by name, for a batch: spark.read.format("codefs"). Options: path; gitignore (true)."""

    @classmethod
    def name(cls) -> str:
        return "codefs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CodeFiles)


def file_tree(root: str, depth: int = 2) -> str:
    """A directory as a tree, directories first. The connector counts skipped entries too, so a last visible entry may not look last."""
    root = os.path.abspath(root)
    if not os.path.isdir(root):
        return f"Error: Path {root} " + ("is not a directory." if os.path.exists(root) else "does not exist.")
    lines = [f"# File Tree for {os.path.basename(root)}"]

    def show(folder: str, level: int, lead: str) -> None:
        if level > depth:
            return
        entries = sorted(os.scandir(folder), key=lambda e: (not e.is_dir(), e.name))
        for i, e in enumerate(entries):
            if e.name in EXCLUDED_DIRS or e.name.startswith((".", "__")):
                continue
            last = i == len(entries) - 1
            lines.append(f"{lead}{'└── ' if last else '├── '}{e.name}{'/' if e.is_dir() else ''}")
            if e.is_dir():
                show(e.path, level + 1, lead + ("    " if last else "│   "))

    show(root, 1, "")
    return "\n".join(lines)

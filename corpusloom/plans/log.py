"""A log of numbered entries in a shared folder: what a table consists of, as its last entry says.

Entries are JSON documents that are created once and never changed. Creating one fails if another writer has
created the same number, so that of two that began from the same entry one has to read again and repeat.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Log:
    """folder/log/<number>.json; all paths are relative to the folder, which is on any storage that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def names(self, folder: str) -> list[str]:
        fs, path = self._path(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def last(self) -> dict | None:
        """The last entry, None for an empty log."""
        numbers = [n for n in self.names("log") if n.endswith(".json")]
        if not numbers:
            return None
        fs, path = self._path(f"log/{max(numbers)}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def commit(self, entry: dict) -> None:
        """Create the entry with the number entry["version"]."""
        fs, path = self._path(f"log/{entry['version']:012d}.json")
        try:
            out = fs.create(path, False)
        except Exception as e:
            raise RuntimeError(f"version {entry['version']} has been written by another; read again and repeat") from e
        out.write(bytearray(json.dumps(entry), "utf-8"))
        out.close()

    def remove(self, name: str) -> bool:
        fs, path = self._path(name)
        return fs.delete(path, True)

    def keep_only(self, wanted: dict[str, set[str]]) -> int:
        """Delete what else lies in these folders; how many names went."""
        return sum(self.remove(f"{folder}/{name}") for folder, keep in wanted.items() for name in self.names(folder) if name not in keep and not name.startswith(("_", ".")))

    @staticmethod
    def entry(version: int) -> str:
        return f"{version:012d}.json"

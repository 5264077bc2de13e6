"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.staging import shared_folder, staged

__all__ = ["WORD", "WordScores", "crc_of_id", "fresh", "hashed_subwords", "in_slices", "memo", "of_texts", "one_per_id", "release_memos", "shared_folder", "smallest_by_hash", "staged", "table", "trained", "trim"]

#: What separates words: the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names starting with those given that clash with no column of df (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of an id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def smallest_by_hash(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """The rows of df whose seeded hash of key is among the `rows` smallest: a repeatable bounded sample.

    Only hashes travel to find the limit, so texts aren't sorted. Rows that share the last hash are all
    kept; callers hold the bound with limit() where keys can repeat.
    """
    (name,) = fresh(df, "_hash")
    hashed = df.withColumn(name, F.xxhash64(F.col(key), F.lit(seed)))
    top = hashed.select(name).orderBy(name).limit(rows).agg(F.max(name)).first()[0]
    return hashed.filter(F.col(name) <= F.lit(top if top is not None else -(2**63))).drop(name)


def one_per_id(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row for each value of key, the least by columns, so that repeated ids can't change from run to run what is learned from."""
    return df.groupBy(key).agg(F.min(F.struct(*columns)).alias("_least")).select(key, "_least.*")


def of_texts(schema: str, start: Callable[[], Callable[[list[str | None]], object]], text: str = "text") -> Column:
    """A column of what a task's function, made by start(), gives for the texts of a batch; all other columns stay in the JVM.

    The function returns a row per text: a DataFrame for a struct, a list or array otherwise.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[object]:
        work = start()
        for texts in batches:
            yield work([t if isinstance(t, str) else None for t in texts])
        del work
        trim()

    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from run(batches)

    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from map(pd.Series, run(batches))

    return F.pandas_udf(rows if "," in schema and "<" not in schema else values, schema)(text)


_MEMOS: dict[object, object] = {}
try:
    _LIBC = ctypes.CDLL(None)
except (OSError, TypeError):  # no C library of this kind
    _LIBC = None


def memo(key: object, make: Callable[[], object]) -> object:
    """What make() makes, kept in this Python worker from task to task; at most one such thing is kept."""
    if key not in _MEMOS:
        release_memos()
        _MEMOS[key] = make()
    return _MEMOS[key]


def release_memos() -> None:
    """Tasks that need room of their own call this first: workers outlive the operators that filled them."""
    _MEMOS.clear()
    trim()


def trim() -> None:
    """Give what is free in this worker back to the system: a worker that waits for its next task keeps all that it once needed else."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def trained(sample: DataFrame, learn: Callable[[pd.DataFrame], object]) -> object:
    """What learn() makes of a sample of bounded size, in one task of an executor rather than in the driver; the model comes back pickled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_memos()
        parts = list(batches)
        if parts:
            yield pd.DataFrame({"model": [pickle.dumps(learn(pd.concat(parts, ignore_index=True)))]})

    row = sample.repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(row[0]) if row else learn(pd.DataFrame({c: [] for c in sample.columns}))


def hashed_subwords(words: list[str], buckets: int, shortest: int = 3, longest: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the character n-grams of each word, marked as <word>, and of the word itself.

    Returns two arrays of equal length: the index of the word, and the bucket.
    """
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n) + 2
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(n), lengths)
    room = np.repeat(ends, lengths) - np.arange(len(codes))
    prime, mixer, owners, ids = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15), [], []

    def bucket(h: np.ndarray) -> np.ndarray:
        return (((h ^ (h >> np.uint64(31))) * mixer) >> np.uint64(24)) % np.uint64(buckets)

    rolled = codes.copy()
    for size in range(2, longest + 1):
        rolled = rolled[: len(codes) - size + 1] * prime + codes[size - 1 :]
        if size >= shortest:
            fits = room[: len(rolled)] >= size
            owners.append(owner[: len(rolled)][fits])
            ids.append(bucket(rolled[fits] + np.uint64(size)))
    powers = np.cumprod(np.full(int(lengths.max()), prime, np.uint64))
    place = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
    owners.append(np.arange(n))
    ids.append(bucket(np.add.reduceat(codes * powers[place], ends - lengths)))
    return np.concatenate(owners), np.concatenate(ids).astype(np.int64)


class WordScores:
    """Sums over each word's subwords of rows of a score table, remembered word by word up to a bound.

    table: (buckets, k). For the words of a batch, rows() gives (words, k + 1): the k sums and the number of subwords;
    with `known`, a mark for each of a multiple of the table's buckets, also the number of marked ones.
    """

    def __init__(self, table: np.ndarray, remember: int = 400_000, known: np.ndarray | None = None):
        self.table, self.remember, self.known = np.ascontiguousarray(table, np.float32), remember, known
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.values = np.zeros((0, self.table.shape[1] + 1 + (self.known is not None)), np.float32)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.place]
        if not new:
            return
        if len(self.place) + len(new) > self.remember and self.place:
            self.forget()
            new = list(words)
        if len(self.place) + len(new) > len(self.values):
            grown = np.zeros((max(2 * len(self.values), len(self.place) + len(new)), self.values.shape[1]), np.float32)
            grown[: len(self.place)] = self.values[: len(self.place)]
            self.values = grown
        for a in range(0, len(new), 20_000):
            part, start = new[a : a + 20_000], len(self.place)
            owner, ids = hashed_subwords(part, len(self.table) if self.known is None else len(self.known))
            counts = [np.bincount(owner, minlength=len(part))]
            if self.known is not None:
                counts.append(np.bincount(owner, self.known[ids], len(part)))
                ids %= len(self.table)  # a bucket is the same hash by another modulus
            sums = [np.bincount(owner, self.table[ids, k], len(part)) for k in range(self.table.shape[1])]
            self.values[start : start + len(part)] = np.stack([*sums, *counts], 1)
            self.place.update(zip(part, range(start, start + len(part)), strict=True))

    def rows(self, words: list[str]) -> np.ndarray:
        return self.values[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]


def in_slices(texts: list[str | None], characters: int = 4_000_000):
    """Runs of a batch's rows with about so many characters each, so that a worker's lists of words stay small."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= characters:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)

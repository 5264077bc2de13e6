"""Sparse term vectors and dense embeddings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens

VOCABULARY = 50_000


#: Terms that are counted at a time.
SLICE = 1_000_000


def slices(lists: pa.Array, room: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows): lists in slices of about `room` values at most, or one list; there is always one."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // room)) + 1).tolist(), len(lists)]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        yield low, lists.slice(low, high - low)


def count_terms(lists: pa.Array, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lists of terms: row, idx (ascending in each row) and how often terms that hash to it stand in the row."""
    cells, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low, part in slices(lists, SLICE):
        sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
        terms = part.flatten().dictionary_encode()
        # A term is hashed once, however often it stands in the slice.
        bucket = np.array([int.from_bytes(hashlib.md5(t.encode("utf-8", "surrogatepass")).digest(), "big") % vocabulary for t in terms.dictionary.to_pylist()], np.int64)
        if len(bucket):
            found = np.unique(np.repeat(np.arange(low, low + len(part)), sizes) * vocabulary + bucket[terms.indices.to_numpy()], return_counts=True)
            cells.append(found[0])
            counts.append(found[1])
    cells = np.concatenate(cells)
    return cells // vocabulary, cells % vocabulary, np.concatenate(counts)


def unit_terms(lists: pa.Array, vocabulary: int = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lists of terms: row, idx and val, the sparse vectors of unit length that with_sparse makes."""
    row, idx, tf = count_terms(lists, vocabulary)
    return row, idx, _unit_length(row, tf, len(lists))


def _vectors(text: Column, vocabulary: int, kind: str, value: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> Column:
    """struct(indices, values) of a text; value(row, tf, rows) makes values, of Spark's type `kind`, of the counts. Texts are cut into terms in the JVM and counted in Arrow columns."""

    def made(lists: pa.Array) -> pa.Array:
        row, idx, tf = count_terms(lists, vocabulary)
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(lists)))]), pa.int32())
        both = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((idx, pa.int32()), (value(row, tf, len(lists)), pa.float64() if kind == "double" else pa.int64()))]
        return pa.StructArray.from_arrays(both, names=["indices", "values"])

    def run(lists: pa.Array) -> pa.Array:
        # What is counted at a time is a slice, not the batch.
        return pa.concat_arrays([made(part) for _, part in slices(lists, SLICE)])

    return F.arrow_udf(run, f"struct<indices:array<int>,values:array<{kind}>>")(tokens(text))


def _unit_length(row: np.ndarray, tf: np.ndarray, rows: int) -> np.ndarray:
    return tf / np.sqrt(np.bincount(row, tf * tf, rows))[row]


def term_counts(rows: DataFrame, keys: list[str], text: str = "content", vocabulary: int = VOCABULARY) -> DataFrame:
    """keys, idx, tf: how often terms that hash to idx stand in each text. No shuffle: a row counts its own terms."""
    counted = rows.select(*keys, _vectors(F.col(text), vocabulary, "bigint", lambda row, tf, n: tf).alias("_v"))
    return counted.select(*keys, F.inline(F.arrays_zip("_v.indices", "_v.values")).alias("idx", "tf"))


def postings(rows: DataFrame, keys: list[str], text: str = "content", vocabulary: int = VOCABULARY) -> DataFrame:
    """keys, idx, val: sparse vectors of unit length in long form. Texts without terms have no rows."""
    return postings_of(with_sparse(rows.select(*keys, text), text, vocabulary, "_sparse"), keys, "_sparse")


def postings_of(rows: DataFrame, keys: list[str], column: str = "sparse") -> DataFrame:
    """keys, idx, val of sparse vectors that rows, such as a collection's points, hold."""
    zipped = F.arrays_zip(F.col(f"{column}.indices").alias("idx"), F.col(f"{column}.values").alias("val"))
    return rows.select(*keys, F.inline(zipped).alias("idx", "val"))


def with_sparse(rows: DataFrame, text: str = "content", vocabulary: int = VOCABULARY, column: str = "sparse") -> DataFrame:
    """rows with a text's sparse vector as struct(indices ascending, values), inside the row; empty arrays for no terms."""
    return rows.withColumn(column, _vectors(F.col(text), vocabulary, "double", _unit_length))


def sparse_of(spark: SparkSession, text: str, vocabulary: int = VOCABULARY) -> Row:
    """One text's sparse vector: indices and values."""
    return with_sparse(spark.createDataFrame([(text,)], "content string"), vocabulary=vocabulary).first().sparse


def vectors_of(postings_df: DataFrame, keys: list[str]) -> DataFrame:
    """Long form to one row per key: struct(indices ascending, values)."""
    packed = postings_df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "val"))).alias("_v"))
    return packed.select(*keys, F.struct(F.col("_v.idx").alias("indices"), F.col("_v.val").alias("values")).alias("sparse"))


class HashingEmbedder:
    """The default provider, which needs no network: signed feature hashing of tokens, normalised to unit length, or with unit=False whole numbers.

    Any object with `dim` and `embed(texts) -> (n, dim) array` can take its place, such as a client of an embedding service.
    """

    def __init__(self, dim: int = 64, unit: bool = True):
        self.dim, self.unit = dim, unit

    def embed(self, texts: list[str]) -> np.ndarray:
        out, places = np.zeros((len(texts), self.dim), np.float64), {}
        for i, text in enumerate(texts):
            for token in re.findall(r"\w+", text.lower()):
                if token not in places:
                    h = int.from_bytes(hashlib.md5(token.encode("utf-8", "surrogatepass")).digest()[:4], "big")
                    places[token] = h % self.dim, 1 - 2 * (h >> 31)
                out[i, places[token][0]] += places[token][1]
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12) if self.unit else out).astype(np.float32)


def with_retries(call: Callable[[], np.ndarray], attempts: int = 5, first_wait: float = 4, longest_wait: float = 120) -> np.ndarray:
    """Waits double from first_wait up to longest_wait; a PermissionError (refused credentials) is not tried again."""
    import time

    wait = first_wait
    for left in reversed(range(attempts)):
        try:
            return call()
        except PermissionError:
            raise
        except Exception:
            if not left:
                raise RuntimeError(f"embedding failed after {attempts} attempts") from None
            time.sleep(wait)
            wait = min(2 * wait, longest_wait)
    raise RuntimeError("no attempt was allowed")


def embed(rows: DataFrame, provider, text: str = "content", batch: int = 100, column: str = "dense", keep_going: bool = False) -> DataFrame:
    """rows with embeddings of a text column, by sub-batches of the provider's requests; a task that fails is run again by Spark.

    keep_going: where a sub-batch has failed for good, its texts are tried one by one, and those that fail get null.
    Refused credentials end the task all the same.
    """

    def request(texts: list[str]) -> list:
        try:
            return list(np.asarray(with_retries(lambda: provider.embed(texts)), np.float32))
        except PermissionError:
            raise
        except Exception:
            if not keep_going:
                raise
        out = []
        for t in texts:
            try:
                out.append(np.asarray(provider.embed([t])[0], np.float32))
            except PermissionError:
                raise
            except Exception:
                out.append(None)
        return out

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = [t if t is not None else "" for t in texts]
            yield pd.Series([v for a in range(0, len(values), batch) for v in request(values[a : a + batch])], dtype=object)

    return rows.withColumn(column, run(F.col(text)))


def embed_query(provider, text: str) -> list[float]:
    """One text's embedding; an empty one is an error."""
    if not text:
        raise ValueError("no text to embed")
    return [float(x) for x in provider.embed([text])[0]]

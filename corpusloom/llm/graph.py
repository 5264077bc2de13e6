"""Connected components of links, and rows of groups as Arrow tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import staged


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """node, root (the component's smallest node) for all nodes of links(a, b); ids of any orderable type.

    Alternating stars: every node hands its larger neighbours, then its smaller ones, to the smallest it knows,
    until nothing changes. A round is a minimum per node and a join back, so that no node's neighbours meet in
    one group; minima and results are written to the shared folder, which lets Spark split a hub's rows in the join. Links to itself and null ends are ignored.
    """
    edges = staged(links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), tag)
        large = staged(both.filter("b > a").join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), tag)
        lowest = staged(large.groupBy("a").agg(F.min("b").alias("m")), tag)
        small = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()
        edges = staged(small, tag)
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of batches sorted by a long column, tables that end where a group ends, with the groups' bounds in them."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table, last: bool) -> tuple[pa.Table, np.ndarray, pa.Table]:
        keys = table.column(key).to_numpy()
        bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)] if last else []]).astype(np.int64)
        return table.slice(0, bounds[-1]), bounds, table.slice(bounds[-1])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        first, last = table.column(key)[0].as_py(), table.column(key)[-1].as_py()
        if first != last:
            done, bounds, rest = cut(table, False)
            held = rest.combine_chunks().to_batches()
            yield done.combine_chunks(), bounds
    if held and (table := pa.Table.from_batches(held)).num_rows:
        done, bounds, _ = cut(table, True)
        yield done.combine_chunks(), bounds


def fixed_width(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A binary column whose values all have `width` bytes, as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)

"""Places in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.plans.staging import staged


def positioned(rows: DataFrame, keys: list[str], sums: dict[str, F.Column] | None = None, column: str = "_at") -> DataFrame:
    """rows with their place, from 0, in the order of keys, and for each name in sums the sum of its expression over the rows before.

    A sort by ranges, then totals of each task (a row per task) added to what stands before a row in its own task.
    """
    sums = sums or {}
    sorted_ = staged(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()), "order")
    task = F.shiftright("_id", 33)
    totals = sorted_.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"), *[F.sum(e).alias(f"_sum_{name}") for name, e in sums.items()])
    before = W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_task", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in totals.columns if c != "_task"])
    own = W.partitionBy("_task").orderBy("_id")
    placed = sorted_.withColumn("_task", task).withColumns({column: F.row_number().over(own) - 1, **{name: F.coalesce(F.sum(e).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) for name, e in sums.items()}})
    placed = placed.join(F.broadcast(totals), "_task")
    placed = placed.withColumns({column: F.col(column) + F.col("_n"), **{name: F.col(name) + F.col(f"_sum_{name}") for name in sums}})
    return placed.select(*rows.columns, column, *sums)

"""Ranks over a whole table without a task that sees the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.stored import Scratch


def ranked(df: DataFrame, order: list[Column], name: str, running: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with the rank (from 1) of each row in an order, and sums of ``running`` over all rows before it.

    Rows are dealt by range and numbered inside their partition; what the partitions before hold
    comes from a table of one row a partition. The dealt rows are written once to the shared folder, so
    that both uses see the same boundaries and nothing stays in the executors' caches.
    """
    sums = running or {}
    dealt = df.repartitionByRange(*order).withColumns({"_p": F.spark_partition_id(), **{f"_x_{c}": e for c, e in sums.items()}})
    dealt = Scratch(df.sparkSession, "ranked").save(dealt, "dealt")
    own = Window.partitionBy("_p").orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("_i", F.row_number().over(own)).withColumns({f"_b_{c}": F.coalesce(F.sum(f"_x_{c}").over(before), F.lit(0)) for c in sums} if sums else {})
    totals = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_x_{c}").alias(f"_t_{c}") for c in sums])
    # One row a partition: a few thousand at most.
    parts = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_p", F.coalesce(F.sum("_n").over(parts), F.lit(0)).alias("_o"), *[F.coalesce(F.sum(f"_t_{c}").over(parts), F.lit(0)).alias(f"_o_{c}") for c in sums])
    out = inside.join(F.broadcast(offsets), "_p").withColumns({name: F.col("_o") + F.col("_i"), **{c: F.col(f"_o_{c}") + F.col(f"_b_{c}") for c in sums}})
    return out.drop("_p", "_i", "_o", *[f"_{k}_{c}" for c in sums for k in "xbo"])

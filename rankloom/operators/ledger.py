"""Cost ledger: totals per label and run, and exact running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def cost_rollup(ledger: DataFrame) -> DataFrame:
    """Totals per (run, label), per run and overall; null marks a subtotal. Totals keep the wider type of
    the sum: that of the rows overflows at a trillion."""
    return ledger.rollup("run_id", "label").agg(
        F.sum("usd").alias("usd"),
        F.count("*").alias("calls"),
        F.grouping_id().alias("level"),
    )


def running_cost(ledger: DataFrame, block: int = 100_000) -> DataFrame:
    """Adds the running total of each run in seq order, exact decimals.

    Two levels: a running sum inside blocks of consecutive seq numbers, plus the total of the
    blocks before. A run of any size is spread over its blocks; only block totals are summed in
    one place.
    """
    rows = ledger.withColumn("block", F.floor(F.col("seq") / block))
    totals = rows.groupBy("run_id", "block").agg(F.sum("usd").alias("block_usd"))
    earlier = (
        W.partitionBy("run_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = totals.withColumn("before", F.sum("block_usd").over(earlier)).drop("block_usd")
    inside = (
        W.partitionBy("run_id", "block")
        .orderBy("seq")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    zero = F.lit(0).cast("decimal(18,6)")
    return (
        rows.withColumn("so_far", F.sum("usd").over(inside))
        .join(offsets, ["run_id", "block"])
        .withColumn(
            "running_usd",
            (F.col("so_far") + F.coalesce("before", zero)).cast("decimal(38,6)"),
        )
        .drop("block", "so_far", "before")
    )

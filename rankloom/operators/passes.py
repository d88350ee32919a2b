"""Rows of several passes as one table, and results refreshed only where something is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_passes(passes: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row per key, from the earliest pass that has it; adds `pass` (from 1). Rows of one pass that
    share a key are told apart by their other columns, the smallest counts."""
    rows = passes[0].withColumn("pass", F.lit(1))
    for number, more in enumerate(passes[1:], 2):
        rows = rows.unionByName(more.withColumn("pass", F.lit(number)))
    rest = [c for c in rows.columns if c not in keys and c != "pass"]
    first = F.min(F.struct("pass", *rest)).alias("row")
    return rows.groupBy(*keys).agg(first).select(*keys, "row.*")


def refresh(
    previous: DataFrame,
    inputs: list[DataFrame],
    new: DataFrame,
    compute: Callable[..., DataFrame],
    group: str = "run_id",
) -> DataFrame:
    """`previous` with the groups that hold `new` rows computed again: compute(*inputs), inputs cut down
    to those groups (those without the group column are passed on whole). Other groups stay as they
    were, and nothing is computed for them."""
    touched = new.select(group).distinct()
    cut = [df.join(touched, group, "left_semi") if group in df.columns else df for df in inputs]
    again = compute(*cut)
    kept = previous.join(touched, group, "left_anti")
    return kept.unionByName(again.select(previous.columns))

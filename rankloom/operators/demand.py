"""Search demand: monthly figures, related keywords, the demand gate and the difficulty ceiling."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rankloom.functions.numeric import half_even_int
from rankloom.functions.text import in_autocomplete, normalise_phrase
from rankloom.settings import GapSettings, Thresholds


def monthly_demand(
    impressions: DataFrame, keys: list[str], today: dt.date, weeks: int = 12
) -> DataFrame:
    """Impressions of the weeks in (today - weeks, today] as a monthly figure. Weeks without
    impressions have no row, so the sum is divided by the window, not by the rows."""
    start = today - dt.timedelta(weeks=weeks)
    inside = (F.col("week_date") > F.lit(start)) & (F.col("week_date") <= F.lit(today))
    monthly = F.sum("impressions") / F.lit(float(weeks)) * F.lit(52 / 12)
    return (
        impressions.filter(inside).groupBy(*keys).agg(half_even_int(monthly).alias("searches"))
    )


def related_demand(related: DataFrame, limit: int) -> DataFrame:
    """(phrase, suggestion, impressions over three months, pos) -> the most searched suggestions
    per phrase with their monthly figure."""
    monthly = related.filter(F.col("suggestion") != "").select(
        "phrase",
        "pos",
        normalise_phrase(F.col("suggestion")).alias("keyword"),
        half_even_int(F.col("impressions") / F.lit(3.0)).alias("volume"),
    )
    order = W.partitionBy("phrase").orderBy(F.desc("volume"), "pos")
    return monthly.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def attach_demand(
    candidates: DataFrame,
    volumes: DataFrame,
    suggestions: DataFrame | None,
    unmeasured: DataFrame | None = None,
) -> DataFrame:
    """Adds `searches` and `autocomplete` to candidates (keyword column).

    A keyword the source could not measure stays null; one it simply has no row for is 0.
    `suggestions` is (keyword, list array<string>); no row or a null list means not checked.
    """
    out = candidates.join(
        volumes.select("keyword", F.col("searches").alias("volume")), "keyword", "left"
    )
    value = F.coalesce(F.col("volume"), F.lit(0))
    if unmeasured is not None:
        flags = unmeasured.select("keyword").distinct().withColumn("unmeasured", F.lit(True))
        out = out.join(flags, "keyword", "left")
        value = F.when(F.col("unmeasured"), F.lit(None)).otherwise(value)
    out = out.withColumn("searches", value.cast("int")).drop("volume", "unmeasured")
    if suggestions is None:
        return out.withColumn("autocomplete", F.lit(None).cast("boolean"))
    lists = suggestions.select("keyword", F.col("list"))
    return (
        out.join(lists, "keyword", "left")
        .withColumn("autocomplete", in_autocomplete(F.col("keyword"), F.col("list")))
        .drop("list")
    )


def has_demand(searches: Column, autocomplete: Column, t: Thresholds) -> Column:
    by_count = F.coalesce(searches, F.lit(0)) >= t.min_impressions
    if not t.autocomplete_counts:
        return by_count
    return by_count | F.coalesce(autocomplete, F.lit(False))


def demand_gate(candidates: DataFrame, t: Thresholds, free: bool = True) -> DataFrame:
    """Adds `kept` and the reason a candidate is dropped. Needs volume, in_autocomplete."""
    floor = t.min_impressions if free else t.min_volume
    seen = F.coalesce(F.col("in_autocomplete"), F.lit(False)) if free else F.lit(False)
    kept = (F.col("volume") >= floor) | seen
    text = F.col("volume").cast("string")
    reason = (
        F.concat(F.lit("no demand: "), text,
                 F.lit(f" Bing impressions < {floor}, not in Google autocomplete"))
        if free
        else F.concat(F.lit("volume "), text, F.lit(f" < {floor}"))
    )
    return candidates.withColumns(
        {"kept": kept, "reason": F.when(~kept, reason).otherwise(F.lit(""))}
    )


def difficulty_ceiling(candidates: DataFrame, s: GapSettings) -> DataFrame:
    """Adds `kept` and a reason from the difficulty a site of this strength can win."""
    ceiling = s.thresholds.ceiling(s.site_strength)
    d = F.col("difficulty")
    reason = F.when(d.isNull(), F.lit("no difficulty score")).when(
        d > ceiling,
        F.concat(F.lit("difficulty "), d.cast("string"),
                 F.lit(f" > {ceiling} ({s.site_strength} site)")),
    )
    return candidates.withColumns(
        {"kept": reason.isNull(), "reason": F.coalesce(reason, F.lit(""))}
    )

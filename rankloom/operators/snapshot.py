"""Site snapshot: keyword list, position groups, top pages, totals, page speed, link history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rankloom.functions.labels import vital_status
from rankloom.settings import SnapshotSettings


def snapshot_keywords(metrics: DataFrame, ord_: int = 0) -> DataFrame:
    """Rows of one site of each run. The URL is the ranking page, or the page that targets the
    keyword (`target_url`, when the input has it) while it does not rank."""
    site = F.element_at(F.filter("sites", lambda x: x["ord"] == ord_), 1)
    target = F.col("target_url") if "target_url" in metrics.columns else F.lit("")
    return metrics.withColumn("site", site).select(
        "run_id",
        F.col("site.domain").alias("domain"),
        "keyword",
        F.col("site.position").alias("position"),
        F.coalesce(F.nullif(F.col("site.url"), F.lit("")), target, F.lit("")).alias("url"),
        F.col("site.position").isNotNull().alias("ranked"),
        "searches",
        "searches_status",
        "estimate",
        F.col("site.visits").alias("visits"),
        "difficulty",
        "difficulty_band",
        "intent",
    )


def listing_order() -> list:
    """Ranked keywords first, best position first, then the most searched."""
    return [
        F.col("position").asc_nulls_last(),
        F.coalesce("searches", F.lit(0)).desc(),
        F.col("keyword").asc(),
    ]


def filter_listing(keywords: DataFrame, tab: str = "all", text: str = "") -> DataFrame:
    if tab == "found":
        keywords = keywords.filter("ranked")
    elif tab == "not":
        keywords = keywords.filter("NOT ranked")
    needle = text.strip().lower()
    return keywords.filter(F.contains("keyword", F.lit(needle))) if needle else keywords


def position_groups(keywords: DataFrame, s: SnapshotSettings) -> DataFrame:
    """Keywords per position group and run, empty groups included, plus the rest. The groups are
    a handful of settings, so they are counters of one aggregation."""
    last = s.position_groups[-1][1] if s.position_groups else s.gap.depth
    counters, labels = [], []
    for low, high in s.position_groups:
        labels.append(f"{low}-{high}")
        counters.append(F.count_if(F.col("position").between(low, high)))
    labels.append(f"not in top {last}")
    counters.append(F.count_if(F.col("position").isNull() | (F.col("position") > last)))
    per_run = keywords.groupBy("run_id").agg(
        *[c.cast("long").alias(x) for c, x in zip(counters, labels, strict=True)]
    )
    return per_run.unpivot("run_id", labels, "label", "keywords")


def top_pages(keywords: DataFrame, limit: int) -> DataFrame:
    """Pages by visits (unknown last), then keywords, then best position."""
    pages = (
        keywords.filter(F.col("ranked") & (F.col("url") != ""))
        .groupBy("run_id", "url")
        .agg(
            F.sum("visits").alias("visits"),
            F.count("*").alias("keywords"),
            F.min("position").alias("best_position"),
        )
    )
    order = W.partitionBy("run_id").orderBy(
        F.col("visits").desc_nulls_last(), F.desc("keywords"), "best_position", "url"
    )
    return pages.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def top_page_keywords(keywords: DataFrame, pages: DataFrame) -> DataFrame:
    """The keywords of the top pages, one row each; order by position within a page."""
    return keywords.filter("ranked").join(
        pages.select("run_id", "url", "place"), ["run_id", "url"]
    ).select("run_id", "place", "url", "position", "keyword")


def totals(keywords: DataFrame) -> DataFrame:
    return keywords.groupBy("run_id", "domain").agg(
        F.count("*").alias("keywords_checked"),
        F.count_if("ranked").alias("keywords_found"),
        F.sum("visits").alias("visits"),
        F.count("visits").alias("visits_keywords"),
    )


def vital_results(vitals: DataFrame, s: SnapshotSettings) -> DataFrame:
    """(origin, metric, p75) with its grade; metrics without limits are left out."""
    return vitals.withColumn("status", vital_status(F.col("metric"), F.col("p75"), s)).filter(
        F.col("status").isNotNull()
    )


def recent_history(history: DataFrame, months: int | None) -> DataFrame:
    """The last n points of each domain's link-score history; None keeps all."""
    if months is None:
        return history
    newest = W.partitionBy("domain").orderBy(F.desc("month"))
    return (
        history.withColumn("n", F.row_number().over(newest))
        .filter(F.col("n") <= months)
        .drop("n")
    )

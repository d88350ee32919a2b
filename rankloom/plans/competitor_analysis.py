"""Competitor analysis: pooled results, page reading and the filter cascade, for every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom import fixed_values as fv
from rankloom.functions.page_type import guess_page_type
from rankloom.functions.url import domain_of, in_domains
from rankloom.operators import competitors
from rankloom.settings import Thresholds
from rankloom.sources.pages import page_features


def pages_worth_reading(pooled: DataFrame) -> DataFrame:
    """Results that pass the filters needing no page text; only these are read."""
    return pooled.filter(
        ~in_domains(domain_of(F.col("url")), fv.AUTHORITY_DOMAINS)
        & ~F.col("page_type").isin(fv.WRONG_FORMAT_TYPES)
    )


def read_pages(html_pages: DataFrame, pooled: DataFrame, t: Thresholds) -> DataFrame:
    """Features of the pages worth reading: the cheap filters run before the page walk."""
    wanted = pages_worth_reading(pooled).select("url").distinct()
    chosen = html_pages.join(wanted, "url", "left_semi")
    features = page_features(chosen, t)
    return features.select(
        "url",
        guess_page_type(F.col("url"), F.col("title"), F.col("schema_type")).alias("read_type"),
        "words",
        "status",
    )


def competitor_analysis(
    serp: DataFrame,
    pages: DataFrame,
    ours: DataFrame,
    t: Thresholds,
    judged_types: DataFrame | None = None,
) -> DataFrame:
    """Every pooled page with the reason it was dropped, null for the ones kept. pages: url,
    read_type, words, status; judged_types: url, judged_type for pages no rule could classify."""
    pooled = competitors.pool_results(serp)
    if judged_types is not None:
        pages = pages.join(judged_types, "url", "left").withColumn(
            "read_type",
            F.when(
                F.col("read_type") == "unknown", F.coalesce("judged_type", "read_type")
            ).otherwise(F.col("read_type")),
        )
    return competitors.competitor_cascade(pooled, pages, ours, t)

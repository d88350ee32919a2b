"""Keyword metrics and keyword gap over every run at once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import clusters, gap, ranks
from rankloom.settings import GapSettings


class GapResult:
    """The analysis of every run; each table is planned when it is first asked for."""

    def __init__(
        self,
        rows: DataFrame,
        keywords: DataFrame,
        serp: DataFrame,
        run_domains: DataFrame,
        s: GapSettings,
    ) -> None:
        self.rows = rows
        self._inputs = (serp, keywords, run_domains)
        self._s = s

    @cached_property
    def top(self) -> DataFrame:
        return gap.top_keywords(self.rows, self._s)

    @cached_property
    def counts(self) -> DataFrame:
        return gap.category_counts(self.rows)

    @cached_property
    def tiles(self) -> DataFrame:
        return gap.site_tiles(self.rows)

    @cached_property
    def panels(self) -> DataFrame:
        return gap.competitor_panels(self.rows)

    @cached_property
    def panel_top(self) -> DataFrame:
        return gap.competitor_top(self.rows, self._s)

    @cached_property
    def suggested(self) -> DataFrame:
        return gap.suggested_competitors(*self._inputs, self._s)


def metric_rows(
    keywords: DataFrame,
    serp: DataFrame,
    run_domains: DataFrame,
    site_ranks: DataFrame,
    s: GapSettings,
    has_source: bool = True,
) -> DataFrame:
    """One row per keyword. `keywords`: run_id, keyword, business_fit, searches, autocomplete and
    any columns to carry along (sources, target pages)."""
    positions = ranks.with_positions(keywords, serp, run_domains, s)
    profile = ranks.serp_profile(serp, site_ranks, s.thresholds)
    return gap.keyword_metrics(positions, profile, s, has_source)


def lead_order() -> list:
    """Better-fitting, better-measured keywords lead their group, then discovery order."""
    return [
        -F.coalesce("business_fit", F.lit(0)),
        -F.coalesce("searches", F.lit(0)),
        F.col("ord"),
    ]


def with_clusters(rows: DataFrame, keywords: DataFrame, serp: DataFrame, s: GapSettings):
    t = s.thresholds
    leads = clusters.serp_clusters(keywords, serp, lead_order(), t.min_shared_urls, t.serp_top)
    return rows.join(leads, ["run_id", "keyword"], "left").withColumn(
        "cluster", F.coalesce("cluster", "keyword")
    )


def keyword_gap(
    keywords: DataFrame,
    serp: DataFrame,
    run_domains: DataFrame,
    site_ranks: DataFrame,
    s: GapSettings,
    has_source: bool = True,
    cluster: bool = False,
) -> GapResult:
    rows = gap.gap_rows(
        metric_rows(keywords, serp, run_domains, site_ranks, s, has_source), s
    )
    if cluster:
        rows = with_clusters(rows, keywords, serp, s)
    return GapResult(rows, keywords, serp, run_domains, s)

"""One-page site snapshot over every run at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame

from rankloom.operators import gap, snapshot
from rankloom.plans.keyword_gap import metric_rows
from rankloom.settings import SnapshotSettings


class Snapshot:
    """The snapshot of every run; each table is planned when it is first asked for."""

    def __init__(self, listing: DataFrame, suggest: Callable[[], DataFrame], s: SnapshotSettings):
        self.keywords = listing
        self._suggest = suggest
        self._s = s

    @cached_property
    def groups(self) -> DataFrame:
        return snapshot.position_groups(self.keywords, self._s)

    @cached_property
    def top_pages(self) -> DataFrame:
        return snapshot.top_pages(self.keywords, self._s.top_pages)

    @cached_property
    def page_keywords(self) -> DataFrame:
        return snapshot.top_page_keywords(self.keywords, self.top_pages)

    @cached_property
    def totals(self) -> DataFrame:
        return snapshot.totals(self.keywords)

    @cached_property
    def competitors(self) -> DataFrame:
        return self._suggest()


def site_snapshot(
    keywords: DataFrame,
    serp: DataFrame,
    run_domains: DataFrame,
    site_ranks: DataFrame,
    s: SnapshotSettings,
    has_source: bool = True,
) -> Snapshot:
    """The first site of each run: its keywords, position groups, top pages, totals and the sites
    that really rank."""
    ours = run_domains.filter("ord = 0")
    rows = metric_rows(keywords, serp, ours, site_ranks, s.gap, has_source)
    return Snapshot(
        snapshot.snapshot_keywords(rows),
        lambda: gap.suggested_competitors(serp, keywords, ours, s.gap),
        s,
    )

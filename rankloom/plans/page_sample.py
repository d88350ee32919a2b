"""Which pages of each site to read, from its sitemap, homepage links and robots rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import sampling
from rankloom.settings import GapSettings


@dataclass(frozen=True)
class PageSample:
    judged: DataFrame
    usable: DataFrame
    pages: DataFrame
    totals: DataFrame


def page_sample(
    entries: DataFrame,
    s: GapSettings,
    rules: DataFrame | None = None,
    home_links: DataFrame | None = None,
    agent: str = "*",
) -> PageSample:
    """entries and home_links: site, pos, url, lastmod; rules: host, agent, allow, pattern."""

    def judge(rows: DataFrame) -> DataFrame:
        ruled = rows if rules is None else sampling.with_robots(rows, rules, agent)
        return sampling.judge_urls(ruled, s)

    judged = judge(entries)
    usable = judged.filter(F.col("reason").isNull()).select("site", "pos", "url", "lastmod")
    if home_links is not None:
        links = judge(home_links).filter(F.col("reason").isNull())
        usable = sampling.top_up(usable, links, s)
    else:
        usable = usable.withColumn("source", F.lit("sitemap"))
    homes = sampling.home_urls(entries)
    if rules is not None:
        homes = (
            sampling.with_robots(homes.withColumn("url", F.col("home")), rules, agent)
            .withColumn("home", F.when(F.col("allowed"), F.col("home")))
            .select("site", "home")
        )
    return PageSample(
        judged=judged,
        usable=usable,
        pages=sampling.select_pages(usable, homes, s.pages_per_site),
        totals=sampling.page_totals(entries, judged),
    )

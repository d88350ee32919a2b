"""Keyword discovery for sets of sites, and the second pass from related searches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rankloom.operators import candidates as c
from rankloom.operators.demand import attach_demand, has_demand
from rankloom.session import cut_lineage
from rankloom.settings import GapSettings, within


@dataclass(frozen=True)
class Discovery:
    pool: DataFrame  # every candidate with demand, brand and fit
    checked: DataFrame  # those whose demand was looked up
    picked: DataFrame  # the balanced set to check positions for
    counts: DataFrame
    missed: DataFrame  # our page keywords nobody searches
    tokens: DataFrame  # brand words that are not generic


def _order(stage: int, *parts) -> Column:
    numbers = [F.coalesce(p, F.lit(0)).cast("long") for p in parts]
    numbers += [F.lit(0).cast("long")] * (3 - len(numbers))
    return F.struct(
        F.lit(stage).alias("stage"), *[n.alias(f"n{i}") for i, n in enumerate(numbers)]
    )


def discover_keywords(
    page_keywords: DataFrame,
    run_domains: DataFrame,
    volumes: DataFrame,
    suggestions: DataFrame | None,
    related: DataFrame | None,
    fits: DataFrame | None,
    s: GapSettings,
    brand_names: DataFrame | None = None,
    unmeasured: DataFrame | None = None,
) -> Discovery:
    """page_keywords: run_id, domain, url, pos, kind_pos, keyword, kind; volumes: keyword,
    searches; suggestions: keyword, list; related: as related_demand returns it; fits: run_id,
    keyword, fit."""
    t = s.thresholds
    sites = run_domains.select("run_id", "domain", F.col("ord").alias("site_ord"))
    phrases = (
        page_keywords.filter(within("kind_pos", s.alternatives_per_page))
        .join(sites, ["run_id", "domain"])
        .select(
            "run_id",
            F.col("keyword").alias("phrase"),
            F.col("kind").alias("source"),
            "domain",
            "url",
            _order(0, F.col("site_ord"), F.col("pos"), F.col("kind_pos")).alias("ord"),
        )
    )
    phrases = c.cleaned(phrases, s)
    tokens = c.brand_tokens(run_domains, brand_names, s)
    first_pool, generic = c.mark_brands(c.merge_variants(phrases), tokens, s)
    first_pool = cut_lineage(first_pool)
    checked = cut_lineage(
        attach_demand(c.demand_checks(first_pool, s), volumes, suggestions, unmeasured)
    )
    pool = first_pool.join(
        checked.select("run_id", "variant_key", "searches", "autocomplete"),
        ["run_id", "variant_key"],
        "left",
    )
    if related is not None:
        pool, generic = _add_related(pool, checked, sites, related, tokens, generic, s)
    if fits is not None:
        pool = pool.join(fits.select("run_id", "keyword", "fit"), ["run_id", "keyword"], "left")
    else:
        pool = pool.withColumn("fit", F.lit(None).cast("int"))
    wanted = F.col("brand_of").isNull() & has_demand(
        F.col("searches"), F.col("autocomplete"), t
    )
    pool = cut_lineage(pool.withColumn("fit", F.when(wanted, F.col("fit"))))
    lists = c.pick_lists(pool.filter(wanted), run_domains, s)
    picked = c.pick_balanced(lists, s.keywords).join(pool, ["run_id", "variant_key"])
    ours = sites.filter("site_ord = 0").select("run_id", F.col("domain").alias("ours"))
    missed = (
        checked.join(ours, "run_id")
        .filter(
            F.col("autocomplete").isNotNull()
            & ~has_demand(F.col("searches"), F.col("autocomplete"), t)
            & F.array_contains("sources", "page")
            & F.exists("pages", lambda p: p["domain"] == F.col("ours"))
        )
        .select("run_id", "keyword")
    )
    return Discovery(
        pool=pool,
        checked=checked,
        picked=picked,
        counts=c.discovery_counts(pool, checked, s),
        missed=missed,
        tokens=tokens.join(generic, ["run_id", "domain", "token"], "left_anti"),
    )


def _add_related(pool, checked, sites, related, tokens, generic, s: GapSettings):
    """Related keywords of each site's best candidates join the pool under their variant key."""
    seeds = c.site_seeds(checked, s)
    found = c.related_phrases(seeds, related, s).join(
        sites.withColumnRenamed("domain", "site"), ["run_id", "site"]
    )
    none = F.lit(None).cast("string")
    rows = cut_lineage(
        found.select(
            "run_id",
            "phrase",
            F.lit("bing related").alias("source"),
            none.alias("domain"),
            none.alias("url"),
            _order(1, F.col("site_ord"), F.col("n"), F.col("place")).alias("ord"),
            "volume",
        )
    )
    merged = c.merge_variants(rows)
    keyed = rows.withColumn("variant_key", c.variant_key(F.col("phrase")))
    volume = keyed.groupBy("run_id", "variant_key").agg(
        F.min_by("volume", "ord").alias("volume")
    )
    extra = merged.join(volume, ["run_id", "variant_key"]).select(
        "run_id", "variant_key", *[F.col(x).alias(f"r_{x}") for x in ("keyword", "ord", "pages")],
        F.col("sources").alias("r_sources"), "volume",
    )
    both = pool.join(extra, ["run_id", "variant_key"], "full")
    empty = F.array().cast("array<string>")
    out = both.select(
        "run_id",
        "variant_key",
        F.coalesce("keyword", "r_keyword").alias("keyword"),
        F.coalesce("ord", "r_ord").alias("ord"),
        F.array_distinct(
            F.concat(F.coalesce("sources", empty), F.coalesce("r_sources", empty))
        ).alias("sources"),
        F.coalesce("pages", "r_pages").alias("pages"),
        "brand_of",
        F.coalesce("searches", F.col("volume").cast("int")).alias("searches"),
        "autocomplete",
    )
    marked, generic_too = c.mark_brands(cut_lineage(out), tokens, s)
    return marked, generic.union(generic_too).distinct()


def second_pass(
    related_searches: DataFrame,
    rankings: DataFrame,
    discovery: Discovery,
    volumes: DataFrame,
    suggestions: DataFrame | None,
    fits: DataFrame | None,
    s: GapSettings,
) -> DataFrame:
    """More keywords where competitors are proven to rank. related_searches: run_id, keyword, pos,
    query; rankings: run_id, keyword, ord, proven."""
    known = discovery.pool.select("run_id", "variant_key")
    fresh = cut_lineage(c.new_related_searches(related_searches, rankings, known, s))
    marked, _ = c.mark_brands(fresh, discovery.tokens, s)
    order = W.partitionBy("run_id").orderBy("ord")
    checks = (
        marked.filter(F.col("brand_of").isNull())
        .withColumn("n", F.row_number().over(order))
        .filter(within("n", s.demand_checks))
        .drop("n")
    )
    judged = attach_demand(checks, volumes, suggestions)
    if fits is not None:
        judged = judged.join(fits.select("run_id", "keyword", "fit"), ["run_id", "keyword"], "left")
    else:
        judged = judged.withColumn("fit", F.lit(None).cast("int"))
    return c.second_pass_pick(judged, s)

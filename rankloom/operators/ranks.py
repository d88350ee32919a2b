"""Rank check, site strength, difficulty, intent and weak spots of result pages.

Result rows: (run_id, keyword, pos, rank, url, domain, title, page_type); `pos` is the place in the
list, `rank` the position reported (ranks can have holes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom import fixed_values as fv
from rankloom.functions.binding import bind
from rankloom.functions.numeric import half_even_int, ordered_sum
from rankloom.functions.text import newest_year
from rankloom.functions.url import domain_parents, no_www, ownership_names
from rankloom.session import cut_lineage
from rankloom.settings import GapSettings, Thresholds

KEY = ["run_id", "keyword"]


def run_sites(run_domains: DataFrame) -> DataFrame:
    """One row per run with its few sites in order: (run_id, sites array<ord, domain>)."""
    return run_domains.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "domain"))).alias("sites")
    )


def best_positions(serp: DataFrame, run_domains: DataFrame) -> DataFrame:
    """Results that belong to a site of the run: (run_id, keyword, hits array<ord, hit>).

    Ownership by suffix is an equi-join on the parents of each distinct domain, so no nested loop and
    no names per result; the pairs of run and domain are written out, so that Spark sees how few they
    are. Only results that belong to a site of the run are grouped, and a result page bounds them.
    """
    named = serp.select("domain").distinct().select(
        "domain", F.explode(ownership_names(F.col("domain"))).alias("name")
    )
    sites = run_domains.select("run_id", "ord", no_www(F.lower("domain")).alias("name"))
    owned = cut_lineage(named.join(sites, "name").select("run_id", "ord", "domain"))
    hits = F.collect_list(F.struct(F.col("ord"), F.struct("rank", "pos", "url").alias("hit"))).alias("hits")
    return serp.join(owned, ["run_id", "domain"]).groupBy(*KEY).agg(hits)


def with_positions(
    keywords: DataFrame, serp: DataFrame, run_domains: DataFrame, s: GapSettings
) -> DataFrame:
    """Keywords plus `sites`: array of (ord, domain, position, url), ours first, with a null
    position and an empty url where the site is not in the results."""
    best = best_positions(serp, run_domains)

    def site(x: Column) -> Column:
        own = F.filter("hits", lambda h: h["ord"] == x["ord"])
        return bind(F.array_min(F.transform(own, lambda h: h["hit"])), lambda hit: placed(x, hit))

    def placed(x: Column, hit: Column) -> Column:
        return F.struct(
            x["ord"].alias("ord"),
            x["domain"].alias("domain"),
            hit["rank"].alias("position"),
            F.coalesce(hit["url"], F.lit("")).alias("url"),
        )

    joined = (
        keywords.join(best, KEY, "left")
        .join(run_sites(run_domains), "run_id")
        .withColumn("sites", F.transform("sites", site))
    )
    return joined.drop("hits")


def rank_check(
    keywords: DataFrame, serp: DataFrame, run_domains: DataFrame, s: GapSettings
) -> DataFrame:
    """Long form: one row per keyword and site."""
    rows = with_positions(keywords.select(*KEY), serp, run_domains, s)
    return rows.select(*KEY, F.inline("sites"))


def competitor_ranks(sites: Column) -> Column:
    return F.exists(sites, lambda x: (x["ord"] > 0) & x["position"].isNotNull())


def domain_ranks(domains: DataFrame, site_ranks: DataFrame) -> DataFrame:
    """(domain, site_rank): the most specific listed name wins, null when none is listed.

    `domains` should hold distinct names; the join then costs one row per name and parent.
    """
    chain = domains.select("domain", F.posexplode(domain_parents(F.col("domain"))))
    ranked = chain.withColumnRenamed("col", "name").join(
        site_ranks.select(F.col("domain").alias("name"), "rank"), "name"
    )
    found = ranked.groupBy("domain").agg(F.min_by("rank", "pos").alias("site_rank"))
    return domains.join(found, "domain", "left")


def exact_lookup(domains: DataFrame, table: DataFrame) -> DataFrame:
    """Site facts of exactly these domains: a subdomain never inherits its parent's numbers."""
    return domains.join(table, "domain", "left")


def strength(page_type: Column, site_rank: Column, t: Thresholds) -> Column:
    by_rank = F.when(site_rank.isNull(), F.lit(t.unlisted_strength))
    for ceiling, value in t.strength_by_rank:
        by_rank = by_rank.when(site_rank <= ceiling, F.lit(value))
    by_rank = by_rank.otherwise(F.lit(t.unlisted_strength))
    return F.when(page_type.isin(fv.UGC_TYPES), F.lit(t.ugc_strength)).otherwise(by_rank)


def most_common(values: Column) -> Column:
    """struct(n, value) of the most frequent entry; ties go to the one seen first."""

    def scored(v: Column) -> Column:
        return F.transform(
            F.array_distinct(v),
            lambda x: F.struct(
                F.size(F.filter(v, lambda y: y == x)).alias("n"),
                (-F.array_position(v, x)).alias("first"),
                x.alias("value"),
            ),
        )

    return F.array_max(bind(values, scored))


def intent_of_types(page_types: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fv.INTENT_OF_TYPE.items() for x in kv])
    intents = F.array_compact(F.transform(page_types, lambda p: F.try_element_at(table, p)))
    return F.coalesce(most_common(intents)["value"], F.lit("unknown"))


def serp_profile(serp: DataFrame, site_ranks: DataFrame, t: Thresholds) -> DataFrame:
    """One row per keyword from its first results: `top` (at most serp_top entries, in list
    order), results, difficulty, small_sites and intent.

    Domain ranks are looked up once per distinct domain and written out, so that Spark sees how few
    they are; then one shuffle on the keyword gives every number the later steps need.
    """
    head = serp.filter(F.col("pos") <= t.serp_top)
    ranks = cut_lineage(domain_ranks(head.select("domain").distinct(), site_ranks))
    top = (
        head.join(ranks, "domain", "left")
        .groupBy(*KEY)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "pos",
                        "rank",
                        "url",
                        "domain",
                        "page_type",
                        strength(F.col("page_type"), F.col("site_rank"), t).alias("strength"),
                        (
                            ~F.col("page_type").isin(fv.UGC_TYPES) & F.col("site_rank").isNull()
                        ).alias("small"),
                        newest_year(F.col("title")).alias("year"),
                    )
                )
            ).alias("top")
        )
    )
    types = F.transform("top", lambda x: x["page_type"])
    n = F.size("top")
    return top.select(
        *KEY,
        "top",
        n.alias("results"),
        half_even_int(F.lit(100.0) * ordered_sum(F.col("top"), "strength") / n).alias(
            "difficulty"
        ),
        F.size(F.filter("top", lambda x: x["small"])).alias("small_sites"),
        intent_of_types(types).alias("intent"),
    )


def known_difficulty(difficulty: Column, results: Column, s: GapSettings) -> Column:
    """Null when too few results came back to judge."""
    return F.when(results >= s.min_results, difficulty)


def intent_verdict(page_types: Column, our_type: Column, t: Thresholds) -> Column:
    """struct(mix, dominant, dominant_share, verdict, flag) of the page types shown."""
    shown = F.filter(page_types, lambda p: ~p.isin(fv.NO_INTENT_TYPES))
    parts = bind(
        shown, lambda known: F.struct(known.alias("known"), _type_mix(known).alias("mix"))
    )
    return bind(parts, lambda x: _verdict(x["known"], x["mix"], our_type, t))


def _type_mix(known: Column) -> Column:
    """Page types with their counts, most frequent first, then first seen."""
    counted = F.transform(
        F.array_distinct(known),
        lambda x: F.struct(
            (-F.size(F.filter(known, lambda y: y == x))).alias("n"),
            F.array_position(known, x).alias("first"),
            x.alias("type"),
        ),
    )
    return F.transform(
        F.array_sort(counted), lambda e: F.struct(e["type"].alias("type"), (-e["n"]).alias("n"))
    )


def _verdict(known: Column, mix: Column, our_type: Column, t: Thresholds) -> Column:
    lead = F.try_element_at(mix, F.lit(1))
    share = lead["n"] / F.size(known)
    verdict = (
        F.when(F.size(known) == 0, "unclear")
        .when(share >= t.clear_share, "clear")
        .when(share <= t.mixed_share, "mixed")
        .otherwise("leaning")
    )
    ours_n = F.aggregate(
        mix, F.lit(0), lambda acc, e: F.when(e["type"] == our_type, e["n"]).otherwise(acc)
    )
    pct = F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))
    judged = (F.size(known) > 0) & our_type.isNotNull() & ~our_type.isin(fv.NO_INTENT_TYPES)
    flag = F.when(
        judged & (ours_n == 0),
        F.concat(
            F.lit("Strong mismatch: no "), our_type,
            F.lit(" pages rank in the top 10; Google shows mostly "), lead["type"],
            F.lit(" pages ("), pct, F.lit(")."),
        ),
    ).when(
        judged & (verdict == "clear") & (our_type != lead["type"]),
        F.concat(
            F.lit("Intent mismatch: "), pct, F.lit(" of the top 10 are "), lead["type"],
            F.lit(" pages; ours is a "), our_type, F.lit(" page ("), ours_n.cast("string"),
            F.lit(" of "), F.size(known).cast("string"), F.lit(" results)."),
        ),
    )
    return F.struct(
        mix.alias("mix"),
        lead["type"].alias("dominant"),
        F.coalesce(F.bround(share, 2), F.lit(0.0)).alias("dominant_share"),
        verdict.alias("verdict"),
        flag.alias("flag"),
    )


def weak_spots(top: Column, small_sites: Column, year: int, t: Thresholds) -> Column:
    """struct(signals, bonus): why the first results can be beaten."""
    forums = F.filter(top, lambda x: x["page_type"] == "forum")
    stale = F.size(F.filter(top, lambda x: x["year"] <= year - t.stale_years))
    small = small_sites >= t.small_sites_min
    signals = F.array_compact(
        F.array(
            F.when(
                F.size(forums) > 0,
                F.concat(F.lit("forum in top 10 ("), F.try_element_at(forums, F.lit(1))["domain"],
                         F.lit(")")),
            ),
            F.when(
                stale > 0, F.concat(stale.cast("string"), F.lit(" stale page(s) in top 10"))
            ),
            F.when(
                small, F.concat(small_sites.cast("string"), F.lit(" small site(s) in top 10"))
            ),
        )
    )
    bonus = (
        F.when(F.size(forums) > 0, F.lit(t.forum_bonus)).otherwise(F.lit(0.0))
        + F.least(stale, F.lit(t.stale_counted)) * F.lit(t.stale_bonus)
        + F.when(small, F.lit(t.small_sites_bonus)).otherwise(F.lit(0.0))
    )
    return F.struct(signals.alias("signals"), bonus.alias("bonus"))


SERP_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("url", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("page_type", T.StringType()),
    ]
)

"""Keyword gap: rows with categories and lift, keywords to add, panels, suggested competitors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rankloom import fixed_values as fv
from rankloom.functions.labels import band, demand_status, gap_categories
from rankloom.functions.numeric import ctr_at, half_even, half_even_int, share_ratio
from rankloom.functions.url import domain_parents, no_www, ownership_names
from rankloom.operators.ranks import known_difficulty, run_sites
from rankloom.settings import GapSettings

KEY = ["run_id", "keyword"]


def keyword_metrics(
    positions: DataFrame, profile: DataFrame, s: GapSettings, has_source: bool = True
) -> DataFrame:
    """Per keyword: demand status, rough searches on the main engine, visits per site, difficulty
    and intent. `positions` is the output of with_positions plus searches, autocomplete, fit."""
    status = demand_status(F.col("searches"), F.lit(has_source))
    measured = F.col("searches_status") == "measured"
    ratio = share_ratio(F.lit(s.country), s)
    estimate = F.when(measured, half_even_int(F.col("searches") * ratio))

    def with_visits(x: Column) -> Column:
        return F.struct(
            x["ord"].alias("ord"),
            x["domain"].alias("domain"),
            x["position"].alias("position"),
            x["url"].alias("url"),
            half_even_int(F.col("estimate") * ctr_at(x["position"], s)).alias("visits"),
        )

    rows = positions.join(profile.drop("top"), KEY, "left")
    difficulty = known_difficulty(F.col("difficulty"), F.col("results"), s)
    return (
        rows.withColumn("searches_status", status)
        .withColumn("estimate", estimate)
        .withColumn("searches", F.when(measured, F.col("searches")))
        .withColumn("difficulty", difficulty)
        .withColumn("difficulty_band", band(F.col("difficulty"), s))
        .withColumn("intent", F.coalesce("intent", F.lit("unknown")))
        .withColumn("sites", F.transform("sites", with_visits))
        .drop("results", "small_sites")
    )


def gap_rows(metrics: DataFrame, s: GapSettings) -> DataFrame:
    """Adds our_position, categories, proof and traffic lift: projections only, no shuffle."""
    rivals = F.filter("sites", lambda x: x["ord"] > 0)
    places = F.array_sort(
        F.array_compact(F.transform(F.col("rivals"), lambda x: x["position"]))
    )
    placed = (
        metrics.withColumns(
            {"our_position": F.try_element_at("sites", F.lit(1))["position"], "rivals": rivals}
        )
        .withColumn("places", places)
        .withColumns(
            {
                "best": F.try_element_at("places", F.lit(1)),
                "worst": F.try_element_at("places", F.lit(-1)),
                "proof": half_even(
                    F.aggregate("places", F.lit(0.0), lambda acc, p: acc + ctr_at(p, s)), 4
                ),
            }
        )
    )
    ours, best = F.col("our_position"), F.col("best")
    lift = F.greatest(
        F.lit(0), half_even_int(F.col("estimate") * (ctr_at(best, s) - ctr_at(ours, s)))
    )
    known = F.col("estimate").isNotNull() & best.isNotNull()
    return placed.withColumns(
        {
            "categories": gap_categories(
                ours, F.size("places"), F.size("rivals"), best, F.col("worst")
            ),
            "traffic_lift": F.when(known, lift),
        }
    ).drop("rivals", "places", "best", "worst")


def gap_reason(rows: DataFrame, category: Column) -> Column:
    """"2 of 2 competitors rank: a #3, b #8; ..." for a keyword to add."""
    rivals = F.filter("sites", lambda x: x["ord"] > 0)
    ranked = F.array_sort(
        F.transform(
            F.filter(rivals, lambda x: x["position"].isNotNull()),
            lambda x: F.struct(
                x["position"].alias("position"), x["ord"].alias("ord"), x["domain"].alias("d")
            ),
        )
    )
    listed = F.array_join(
        F.transform(
            ranked, lambda x: F.concat(x["d"], F.lit(" #"), x["position"].cast("string"))
        ),
        ", ",
    )
    first = F.try_element_at(ranked, F.lit(1))["position"].cast("string")
    lift = F.col("traffic_lift")
    return F.concat(
        F.size(ranked).cast("string"),
        F.lit(" of "),
        F.size(rivals).cast("string"),
        F.lit(" competitors rank: "),
        listed,
        F.when(
            category == "weak",
            F.concat(F.lit("; you rank #"), F.col("our_position").cast("string")),
        ).otherwise(F.lit("")),
        F.when(
            lift > 0,
            F.concat(F.lit("; about "), lift.cast("string"),
                     F.lit(" more visits a month at #"), first),
        ).otherwise(F.lit("")),
    )


def top_keywords(rows: DataFrame, s: GapSettings) -> DataFrame:
    """The keywords to add per run, best first."""
    category = F.try_element_at(
        F.array_intersect(F.array(*[F.lit(c) for c in fv.CATEGORIES_TO_ADD]), "categories"),
        F.lit(1),
    )
    fit = F.coalesce("business_fit", F.lit(s.min_fit))
    order = W.partitionBy("run_id").orderBy(
        fit.desc(),
        F.desc("proof"),
        F.coalesce("difficulty", F.lit(101)),
        F.coalesce("searches", F.lit(0)).desc(),
        "keyword",
    )
    best = F.array_min(
        F.transform(
            F.filter("sites", lambda x: (x["ord"] > 0) & x["position"].isNotNull()),
            lambda x: F.struct(
                x["position"].alias("position"),
                x["ord"].alias("ord"),
                x["domain"].alias("domain"),
                x["url"].alias("url"),
            ),
        )
    )
    picked = (
        rows.withColumn("category", category)
        .filter(F.col("category").isNotNull() & (fit >= s.min_fit))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= s.top_keywords)
        .withColumn("best", best)
    )
    return picked.select(
        "run_id",
        "place",
        "keyword",
        "category",
        gap_reason(rows, F.col("category")).alias("reason"),
        "business_fit",
        "proof",
        "difficulty",
        "difficulty_band",
        "traffic_lift",
        F.col("best.domain").alias("best_competitor"),
        F.col("best.position").alias("best_position"),
        F.col("best.url").alias("best_url"),
    )


def category_counts(rows: DataFrame) -> DataFrame:
    """Keywords per category and run, zeros included: six counters in one pass, then unpivoted."""
    counters = [
        F.count_if(F.array_contains("categories", c)).cast("long").alias(c) for c in fv.CATEGORIES
    ]
    return (
        rows.groupBy("run_id")
        .agg(*counters)
        .unpivot("run_id", fv.CATEGORIES, "category", "keywords")
    )


def site_rows(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY, F.inline("sites"))


def site_tiles(rows: DataFrame) -> DataFrame:
    """Per site: keywords found, on page one, and visits (unknown counts as nothing)."""
    found = F.col("position").isNotNull()
    return (
        site_rows(rows)
        .groupBy("run_id", "ord", "domain")
        .agg(
            F.count_if(found).alias("found"),
            F.count_if(F.col("position") <= 10).alias("page_one"),
            F.coalesce(F.sum("visits"), F.lit(0)).alias("visits"),
            F.count("*").alias("keywords"),
        )
    )


def competitor_panels(rows: DataFrame) -> DataFrame:
    """Per competitor: keywords ranked and visits known."""
    ranked = F.col("position").isNotNull()
    return (
        site_rows(rows)
        .filter(F.col("ord") > 0)
        .groupBy("run_id", "ord", "domain")
        .agg(
            F.count_if(ranked).alias("keywords_ranked"),
            F.coalesce(F.sum(F.when(ranked, F.col("visits"))), F.lit(0)).alias("visits_known"),
        )
    )


def competitor_top(rows: DataFrame, s: GapSettings) -> DataFrame:
    """The best keywords of each competitor, most visits first."""
    order = W.partitionBy("run_id", "ord").orderBy(
        F.coalesce("visits", F.lit(0)).desc(), "position", "keyword"
    )
    return (
        site_rows(rows)
        .filter((F.col("ord") > 0) & F.col("position").isNotNull())
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= s.top_keywords)
        .select("run_id", "ord", "domain", "place", "keyword", "position", "url", "visits")
    )


def suggested_competitors(
    serp: DataFrame, keywords: DataFrame, run_domains: DataFrame, s: GapSettings
) -> DataFrame:
    """Sites on page one for well-fitting keywords that are not in the analysis, platforms and
    user-generated pages left out."""
    fit = F.col("business_fit")
    wanted = keywords.filter(fit.isNull() | (fit >= s.min_fit)).select(*KEY)
    ours = run_sites(run_domains).select(
        "run_id",
        F.transform("sites", lambda x: no_www(F.lower(x["domain"]))).alias("mine"),
    )
    names = ownership_names(F.col("site"))
    platforms = F.array(*[F.lit(d) for d in fv.PLATFORM_DOMAINS])
    hits = (
        serp.filter((F.col("pos") <= 10) & ~F.col("page_type").isin(fv.UGC_TYPES))
        .select(*KEY, no_www(F.col("domain")).alias("site"), "pos", "rank")
        .filter(~F.arrays_overlap(names, platforms))
        .join(wanted, KEY, "left_semi")
        .join(ours, "run_id")
        .filter(~F.arrays_overlap(names, F.col("mine")))
        .groupBy(*KEY, "site")
        .agg(F.min_by("rank", "pos").alias("rank"))
    )
    scored = (
        hits.groupBy("run_id", "site")
        .agg(F.count("*").alias("keywords"), F.min("rank").alias("best_position"))
        .filter(F.col("keywords") >= s.suggested_min_keywords)
    )
    order = W.partitionBy("run_id").orderBy(F.desc("keywords"), "best_position", "site")
    best = scored.withColumn("place", F.row_number().over(order)).filter(
        F.col("place") <= s.suggested_sites
    )
    nearest = W.partitionBy("run_id", "site").orderBy("rank", "keyword")
    examples = (
        hits.join(best.select("run_id", "site"), ["run_id", "site"], "left_semi")
        .withColumn("n", F.row_number().over(nearest))
        .filter(F.col("n") <= s.suggested_examples)
        .groupBy("run_id", "site")
        .agg(F.array_sort(F.collect_list(F.struct("n", "keyword"))).alias("list"))
        .select(
            "run_id", "site", F.transform("list", lambda x: x["keyword"]).alias("examples")
        )
    )
    return best.join(examples, ["run_id", "site"]).select(
        "run_id", "place", F.col("site").alias("domain"), "keywords", "best_position", "examples"
    )


@dataclass(frozen=True)
class GapFilter:
    """The table filters a user can set; empty values filter nothing."""

    tab: str = "all"
    include: str = ""
    exclude: tuple[str, ...] = ()
    intent: str = ""
    band: str = ""
    min_competitors: int = 0
    ours: str = "any"  # any, page1, page2plus, none
    measured_only: bool = False


def filter_rows(rows: DataFrame, f: GapFilter) -> DataFrame:
    kw = F.lower("keyword")
    ours = F.col("our_position")
    if f.tab == "none":
        rows = rows.filter(F.size("categories") == 0)
    elif f.tab == "all":
        rows = rows.filter(F.size("categories") > 0)
    else:
        rows = rows.filter(F.array_contains("categories", f.tab))
    if f.include:
        rows = rows.filter(F.contains(kw, F.lit(f.include.lower().strip())))
    for word in (w.strip().lower() for w in f.exclude):
        if word:
            rows = rows.filter(~F.contains(kw, F.lit(word)))
    if f.intent:
        rows = rows.filter(F.col("intent") == f.intent)
    if f.band:
        rows = rows.filter(F.col("difficulty_band") == f.band)
    if f.min_competitors:
        rivals = F.filter(
            "sites", lambda x: (x["ord"] > 0) & x["position"].isNotNull()
        )
        rows = rows.filter(F.size(rivals) >= f.min_competitors)
    if f.ours == "page1":
        rows = rows.filter(ours <= 10)
    elif f.ours == "page2plus":
        rows = rows.filter(ours > 10)
    elif f.ours == "none":
        rows = rows.filter(ours.isNull())
    if f.measured_only:
        rows = rows.filter(F.col("searches_status") == "measured")
    return rows


SORT_COLUMNS = {
    "keyword": "keyword",
    "searches": "searches",
    "difficulty": "difficulty",
    "fit": "business_fit",
    "lift": "traffic_lift",
    "proof": "proof",
}


def table_order(key: str = "proof", descending: bool = True) -> list[Column]:
    """Order of the table: nulls last in both directions, keyword breaks ties. `pos:<n>` sorts by the
    position of site n."""
    if key.startswith("pos:"):
        value = F.try_element_at("sites", F.lit(int(key[4:]) + 1))["position"]
    else:
        value = F.col(SORT_COLUMNS[key])
    first = value.desc_nulls_last() if descending else value.asc_nulls_last()
    return [first, F.col("keyword").asc(), F.col("run_id").asc()]


def domain_set_errors(run_domains: DataFrame, s: GapSettings) -> DataFrame:
    """Why a set of sites cannot be analysed: (run_id, problem, detail); no rows when all is well.

    Nested domains are found by an equi-join of each domain's parents with the run's domains.
    """
    sets = run_domains.groupBy("run_id").agg(
        F.count_if(F.col("ord") > 0).alias("rivals"),
        F.countDistinct(F.when(F.col("ord") > 0, F.col("domain"))).alias("distinct_rivals"),
        F.max(F.when(F.col("ord") == 0, F.col("domain"))).alias("ours"),
    )
    none = sets.filter(F.col("rivals") == 0).select(
        "run_id", F.lit("no competitor").alias("problem"), F.lit("").alias("detail")
    )
    many = sets.filter(F.col("rivals") > s.max_competitors).select(
        "run_id", F.lit("too many competitors"), F.col("rivals").cast("string")
    )
    twice = sets.filter(F.col("distinct_rivals") < F.col("rivals")).select(
        "run_id", F.lit("competitor listed twice"), F.lit("")
    )
    own = (
        run_domains.filter(F.col("ord") > 0)
        .join(sets.select("run_id", "ours"), "run_id")
        .filter(F.col("domain") == F.col("ours"))
        .select("run_id", F.lit("own site listed"), "domain")
    )
    parents = run_domains.select(
        "run_id",
        F.col("domain").alias("child"),
        F.explode(domain_parents(F.col("domain"))).alias("domain"),
    ).filter(F.col("child") != F.col("domain"))
    nested = parents.join(
        run_domains.select("run_id", "domain"), ["run_id", "domain"], "left_semi"
    ).select("run_id", F.lit("nested domains"), F.concat("child", F.lit(" in "), "domain"))
    return none.union(many).union(twice).union(own.distinct()).union(nested.distinct())

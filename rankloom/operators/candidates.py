"""Keyword candidates: merging variants, brand words, picking seeds and a balanced set.

A phrase row is (run_id, phrase, source, domain, url, ord); `ord` is any sortable discovery order
that is unique within a run.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rankloom.functions.text import (
    clean_phrase,
    contains_brand,
    is_question,
    normalise_phrase,
    variant_key,
)
from rankloom.functions.url import brand_label
from rankloom.operators.demand import has_demand
from rankloom.session import cut_lineage
from rankloom.settings import GapSettings, Thresholds, within


def merge_variants(phrases: DataFrame, key: Column | None = None) -> DataFrame:
    """One row per run and variant key: the first phrase, sources in order of appearance, and the
    first page of every site.

    The first aggregation keeps one row per source and site, so the arrays of the second are as
    short as the lists of sources and sites, however often a phrase repeats.
    """
    named = phrases.withColumn(
        "variant_key", variant_key(F.col("phrase")) if key is None else key
    )
    firsts = named.groupBy("run_id", "variant_key", "source", "domain").agg(
        F.min(F.struct("ord", "phrase", "url")).alias("first")
    )
    entries = F.array_sort(
        F.collect_list(
            F.struct(
                F.col("first.ord").alias("ord"),
                F.col("first.phrase").alias("phrase"),
                F.col("first.url").alias("url"),
                "source",
                "domain",
            )
        )
    )
    merged = firsts.groupBy("run_id", "variant_key").agg(entries.alias("entries"))
    located = F.filter("entries", lambda e: e["domain"].isNotNull() & e["url"].isNotNull())
    pages = F.filter(
        "located",
        lambda e, i: ~F.exists(
            F.slice("located", F.lit(1), i), lambda before: before["domain"] == e["domain"]
        ),
    )
    return merged.withColumn("located", located).select(
        "run_id",
        "variant_key",
        F.element_at("entries", 1)["phrase"].alias("keyword"),
        F.element_at("entries", 1)["ord"].alias("ord"),
        F.array_distinct(F.transform("entries", lambda e: e["source"])).alias("sources"),
        F.transform(
            pages, lambda e: F.struct(e["domain"].alias("domain"), e["url"].alias("url"))
        ).alias("pages"),
    )


def cleaned(phrases: DataFrame, s: GapSettings) -> DataFrame:
    return phrases.withColumn(
        "phrase", clean_phrase(F.col("phrase"), s.keyword_words, s.keyword_chars)
    ).filter(F.col("phrase").isNotNull())


def brand_tokens(run_domains: DataFrame, names: DataFrame | None, s: GapSettings) -> DataFrame:
    """(run_id, ord, domain, token): each site's own name and its listed brand names."""
    own = run_domains.select("run_id", "ord", "domain", brand_label(F.col("domain")).alias("token"))
    if names is not None:
        listed = names.join(run_domains, ["run_id", "domain"]).select(
            "run_id", "ord", "domain", clean_phrase(F.col("name"), s.brand_words).alias("token")
        )
        own = own.unionByName(listed)
    return own.filter(F.length("token") >= 3).distinct()


def mark_brands(
    candidates: DataFrame, tokens: DataFrame, s: GapSettings
) -> tuple[DataFrame, DataFrame]:
    """Adds `brand_of`, the first site whose brand word a candidate contains; also returns the
    generic words: those found in too many candidates to be a brand.

    A run has a handful of brand words, so they travel as one short array per run and containment
    is a filter on that array instead of a nested-loop join.
    """
    per_run = tokens.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "token", "domain"))).alias("tokens")
    )
    # read twice below: for the generic words and for the marks
    hits = cut_lineage(
        candidates.join(per_run, "run_id", "left")
        .withColumn(
            "hits",
            F.coalesce(
                F.filter("tokens", lambda t: contains_brand(F.col("keyword"), t["token"])),
                F.array().cast("array<struct<ord:int,token:string,domain:string>>"),
            ),
        )
        .drop("tokens")
    )
    pool = hits.groupBy("run_id").agg(F.count("*").alias("pool"))
    generic = (
        hits.select("run_id", F.inline("hits"))
        .groupBy("run_id", "ord", "token", "domain")
        .agg(F.count("*").alias("used"))
        .join(pool, "run_id")
        .filter(
            (F.col("pool") >= s.generic_min_keywords)
            & (F.col("used") > F.col("pool") * s.generic_share)
        )
        .select("run_id", "domain", "token")
    )
    common = generic.groupBy("run_id").agg(
        F.collect_list(F.struct("domain", "token")).alias("common")
    )
    brand = F.filter(
        "hits",
        lambda h: ~F.coalesce(
            F.exists(
                "common",
                lambda c: (c["domain"] == h["domain"]) & (c["token"] == h["token"]),
            ),
            F.lit(False),
        ),
    )
    marked = (
        hits.join(common, "run_id", "left")
        .withColumn("found", F.try_element_at(brand, F.lit(1))["domain"])
        .drop("hits", "common")
    )
    earlier = F.col("brand_of") if "brand_of" in candidates.columns else F.lit(None)
    return (
        marked.withColumn("brand_of", F.coalesce(earlier.cast("string"), F.col("found"))).drop(
            "found"
        ),
        generic,
    )


def rank_order() -> list[Column]:
    """Most searched first, then autocomplete, then more sites targeting it, then discovery."""
    return [
        F.coalesce("searches", F.lit(0)).desc(),
        F.coalesce("autocomplete", F.lit(False)).desc(),
        F.size("pages").desc(),
        F.col("ord").asc(),
    ]


def demand_checks(candidates: DataFrame, s: GapSettings) -> DataFrame:
    """The unbranded candidates worth a demand check: page keywords first, then phrases more
    sites target."""
    order = W.partitionBy("run_id").orderBy(
        F.array_contains("sources", "page").desc(), F.size("pages").desc(), "ord"
    )
    return (
        candidates.filter(F.col("brand_of").isNull())
        .withColumn("n", F.row_number().over(order))
        .filter(within("n", s.demand_checks))
        .drop("n")
    )


def per_site(candidates: DataFrame) -> DataFrame:
    """One row per candidate and site that targets it."""
    return candidates.withColumn("site", F.explode(F.transform("pages", lambda p: p["domain"])))


def site_seeds(checked: DataFrame, s: GapSettings) -> DataFrame:
    """The best candidates with demand of each site."""
    own = per_site(
        checked.filter(has_demand(F.col("searches"), F.col("autocomplete"), s.thresholds))
    )
    order = W.partitionBy("run_id", "site").orderBy(*rank_order())
    return own.withColumn("n", F.row_number().over(order)).filter(within("n", s.seeds_per_site))


def keeps_topic(seed: Column, phrase: Column, shared: int) -> Column:
    """A related phrase shares enough content words with its seed."""
    seed_words = F.array_distinct(F.split(variant_key(seed), " "))
    words = F.array_distinct(F.split(variant_key(phrase), " "))
    need = F.least(F.lit(shared), F.size(seed_words))
    return F.size(F.array_intersect(seed_words, words)) >= need


def related_phrases(seeds: DataFrame, related: DataFrame, s: GapSettings) -> DataFrame:
    """Cleaned related keywords of the seeds: (run_id, phrase, volume, seed, pos). `related` is
    (phrase, keyword, volume, place) as related_demand returns it."""
    lists = related.filter(within("place", s.related_per_seed)).select(
        F.col("phrase").alias("seed"), F.col("keyword").alias("phrase"), "volume", "place"
    )
    joined = seeds.select("run_id", F.col("keyword").alias("seed"), "n", "site").join(lists, "seed")
    return cleaned(joined, s).filter(
        keeps_topic(F.col("seed"), F.col("phrase"), s.related_shared_words)
    )


_PICK = "run_id string, variant_key string, picked int"


def pick_balanced(lists: DataFrame, n: int) -> DataFrame:
    """Round-robin over the sites of a run, best first, a shared keyword taken once, then filled
    from the extras: (run_id, variant_key, picked).

    `lists` is (run_id, list, place, variant_key) with list -1 for extras. A list is read at most
    n deep, so only its first n rows travel: a task sees (sites + 1) * n rows at most.
    """

    def pick(run: pd.DataFrame) -> pd.DataFrame:
        queues = {
            number: iter(rows.sort_values("place")["variant_key"].tolist())
            for number, rows in run.groupby("list")
        }
        extras = queues.pop(-1, iter(()))
        chosen: dict[str, None] = {}
        live = [queues[number] for number in sorted(queues)]
        while live and len(chosen) < n:
            still = []
            for queue in live:
                if len(chosen) >= n:
                    break
                fresh = next((k for k in queue if k not in chosen), None)
                if fresh is not None:
                    chosen[fresh] = None
                    still.append(queue)
            live = still
        for k in extras:
            if len(chosen) >= n:
                break
            chosen.setdefault(k)
        return pd.DataFrame(
            {
                "run_id": run["run_id"].iloc[0],
                "variant_key": list(chosen),
                "picked": range(1, len(chosen) + 1),
            }
        )

    return (
        lists.filter(F.col("place") <= n)
        .select("run_id", "list", "place", "variant_key")
        .groupBy("run_id")
        .applyInPandas(pick, _PICK)
    )


def pick_lists(candidates: DataFrame, run_domains: DataFrame, s: GapSettings) -> DataFrame:
    """The ranked lists pick_balanced reads. Needs fit, pages, searches, autocomplete, ord."""
    fit = F.col("fit")
    strong = candidates.filter(fit.isNull() | (fit >= s.min_fit))
    weak = candidates.filter((fit >= s.fill_min_fit) & (fit < s.min_fit))
    sites = per_site(strong).join(
        run_domains.select("run_id", F.col("domain").alias("site"), F.col("ord").alias("list")),
        ["run_id", "site"],
    )
    extras = strong.filter(F.size("pages") == 0).withColumn("tier", F.lit(0))
    extras = extras.unionByName(weak.withColumn("tier", F.lit(1))).withColumn("list", F.lit(-1))
    place = F.row_number().over(
        W.partitionBy("run_id", "list").orderBy(F.col("tier"), *rank_order())
    )
    cols = ["run_id", "list", "variant_key", "tier", "searches", "autocomplete", "pages", "ord"]
    rows = sites.withColumn("tier", F.lit(0)).select(*cols).unionByName(extras.select(*cols))
    return (
        rows.withColumn("place", place)
        .filter(F.col("place") <= s.keywords)
        .select("run_id", "list", "place", "variant_key")
    )


def discovery_counts(pool: DataFrame, checked: DataFrame, s: GapSettings) -> DataFrame:
    """Per run: candidates, branded, not checked, no demand, no fit."""
    demand = has_demand(F.col("searches"), F.col("autocomplete"), s.thresholds)
    seen = F.col("autocomplete").isNotNull()
    totals = pool.groupBy("run_id").agg(
        F.count("*").alias("candidates"),
        F.count("brand_of").alias("branded"),
        F.count_if(F.col("fit") == 0).alias("no_fit"),
    )
    checks = checked.groupBy("run_id").agg(
        F.count("*").alias("checks"), F.count_if(seen & ~demand).alias("no_demand")
    )
    unbranded = F.col("candidates") - F.col("branded")
    return totals.join(checks, "run_id", "left").select(
        "run_id",
        "candidates",
        "branded",
        "no_fit",
        F.coalesce("no_demand", F.lit(0)).alias("no_demand"),
        (unbranded - F.coalesce("checks", F.lit(0))).alias("not_checked"),
    )


def new_related_searches(
    related: DataFrame, rankings: DataFrame, known_keys: DataFrame, s: GapSettings
) -> DataFrame:
    """Related searches of keywords a competitor ranks for, cleaned and merged, without phrases
    already judged. `related`: run_id, keyword, pos, query; `rankings`: run_id, keyword, ord,
    proven; `known_keys`: run_id, variant_key."""
    proven = rankings.filter("proven").select("run_id", "keyword", F.col("ord").alias("kw_ord"))
    phrases = related.join(proven, ["run_id", "keyword"]).select(
        "run_id",
        F.col("query").alias("phrase"),
        F.lit("related search").alias("source"),
        F.lit(None).cast("string").alias("domain"),
        F.lit(None).cast("string").alias("url"),
        F.struct("kw_ord", "pos").alias("ord"),
    )
    merged = merge_variants(cleaned(phrases, s))
    return merged.join(known_keys, ["run_id", "variant_key"], "left_anti")


def second_pass_pick(candidates: DataFrame, s: GapSettings) -> DataFrame:
    """The best second-pass keywords: fit first (unknown counts as the minimum), then demand."""
    fit = F.col("fit")
    order = W.partitionBy("run_id").orderBy(
        F.coalesce(fit, F.lit(s.min_fit)).desc(), *rank_order()
    )
    return (
        candidates.filter(
            has_demand(F.col("searches"), F.col("autocomplete"), s.thresholds)
            & (fit.isNull() | (fit >= s.min_fit))
        )
        .withColumn("picked", F.row_number().over(order))
        .filter(F.col("picked") <= s.second_pass)
    )


# --- phrase research ---------------------------------------------------------------------------


def union_candidates(rows: DataFrame) -> DataFrame:
    """(run_id, phrase, source, volume, difficulty, intent, in_autocomplete, ord) from all sources
    -> one row per normalised phrase: sources in order, the first measured numbers, and whether
    any source saw it in autocomplete."""
    measured = F.when(
        F.col("volume").isNotNull(), F.struct("ord", "volume", "difficulty", "intent")
    )
    named = rows.withColumn("keyword", normalise_phrase(F.col("phrase"))).filter("keyword <> ''")
    firsts = named.groupBy("run_id", "keyword", "source").agg(
        F.min("ord").alias("ord"),
        F.min(measured).alias("numbers"),
        F.max("in_autocomplete").alias("in_autocomplete"),
    )
    merged = firsts.groupBy("run_id", "keyword").agg(
        F.array_sort(F.collect_list(F.struct("ord", "source"))).alias("sources"),
        F.min("numbers").alias("numbers"),
        F.max("in_autocomplete").alias("in_autocomplete"),
    )
    return merged.select(
        "run_id",
        "keyword",
        F.transform("sources", lambda x: x["source"]).alias("sources"),
        F.element_at("sources", 1)["ord"].alias("ord"),
        F.coalesce("numbers.volume", F.lit(0)).alias("volume"),
        F.col("numbers.difficulty").alias("difficulty"),
        F.coalesce("numbers.intent", F.lit("unknown")).alias("intent"),
        "in_autocomplete",
    )


def pre_score(fit: Column, volume: Column, difficulty: Column | None = None) -> Column:
    """fit x log10(2 + volume) x (1 - difficulty/100); difficulty is left out in free mode."""
    score = fit * F.log10(F.lit(2.0) + volume)
    if difficulty is None:
        return score
    return score * (F.lit(1.0) - F.coalesce(difficulty, F.lit(0)) / F.lit(100.0))


def best_by_score(candidates: DataFrame, score: Column, keep: int | None) -> DataFrame:
    """Adds `place` to the rows of each run, best first, and drops those beyond `keep`."""
    order = W.partitionBy("run_id").orderBy(F.desc("score"), "keyword")
    return (
        candidates.withColumn("score", score)
        .withColumn("place", F.row_number().over(order))
        .filter(within("place", keep))
    )


def question_list(rows: DataFrame, ascii_words: bool = False) -> DataFrame:
    """(run_id, text, source, ord): result-page questions plus question-shaped suggestions,
    distinct by text, first seen first."""
    kept = rows.filter((F.col("source") == "paa") | is_question(F.col("text"), ascii_words))
    return kept.groupBy("run_id", "text").agg(F.min("ord").alias("ord"))


def question_variants(seeds: DataFrame, suggestions: DataFrame, t: Thresholds) -> DataFrame:
    """Suggestions for "what is <seed>", "<seed> vs" and the like, distinct per seed in order.
    `seeds`: run_id, keyword; `suggestions`: phrase, pos, suggestion. The sides are merged: Spark's
    estimate leaves out that rows were exploded, so it would broadcast lists of any length."""
    seed = F.col("keyword")
    forms = [F.concat(F.lit(p + " "), seed) for p in t.question_prefixes]
    forms += [F.concat(seed, F.lit(" " + x)) for x in t.question_suffixes]
    asked = seeds.select("run_id", "keyword", F.posexplode(F.array(*forms)).alias("form", "phrase"))
    found = asked.hint("merge").join(suggestions, "phrase").select(
        "run_id",
        "keyword",
        normalise_phrase(F.col("suggestion")).alias("suggestion"),
        F.struct("form", "pos").alias("ord"),
    )
    return found.groupBy("run_id", "keyword", "suggestion").agg(F.min("ord").alias("ord"))


def cluster_scores(members: DataFrame, heads: DataFrame, s: GapSettings) -> DataFrame:
    """One row per cluster with demand, winnability and score. `members`: run_id, keyword, cluster,
    fit, volume; `heads`: run_id, keyword, difficulty, bonus, signals."""
    sums = members.groupBy("run_id", "cluster").agg(
        F.max("fit").alias("fit"),
        F.sum("volume").alias("total_volume"),
        F.count("*").alias("members"),
    )
    head = heads.select(
        "run_id",
        F.col("keyword").alias("cluster"),
        F.coalesce("difficulty", F.lit(0)).alias("difficulty"),
        "bonus",
        "signals",
    )
    demand = F.log10(F.lit(2.0) + F.col("total_volume"))
    win = F.least(
        F.lit(1.0),
        F.greatest(F.lit(0.0), F.lit(1.0) - F.col("difficulty") / F.lit(100.0) + F.col("bonus")),
    )
    return sums.join(head, ["run_id", "cluster"]).select(
        "run_id",
        "cluster",
        "members",
        "total_volume",
        "difficulty",
        "fit",
        F.bround(demand, 4).alias("demand"),
        F.bround(win, 4).alias("winnability"),
        F.bround(F.col("fit") * demand * win, 4).alias("score"),
        "signals",
    )


def chosen_phrases(scores: DataFrame, heads: DataFrame, s: GapSettings) -> DataFrame:
    """The best clusters of each run with the reason they were chosen."""
    t = s.thresholds
    order = W.partitionBy("run_id").orderBy(F.desc("score"), "cluster")
    best = scores.withColumn("place", F.row_number().over(order)).filter(
        F.col("place") <= t.phrases_per_run
    )
    volume = heads.select("run_id", F.col("keyword").alias("cluster"), "volume", "intent")
    by_count = F.col("volume") >= t.min_impressions
    text = F.when(
        by_count, F.concat(F.col("total_volume").cast("string"), F.lit(" Bing impressions/mo"))
    ).otherwise(F.lit("in Google autocomplete"))
    spots = F.when(
        F.size("signals") > 0, F.concat(F.lit("; "), F.array_join("signals", ", "))
    ).otherwise(F.lit(""))
    reason = F.concat(
        text, F.lit(" across "), F.col("members").cast("string"), F.lit(" phrase(s), difficulty "),
        F.col("difficulty").cast("string"), F.lit(", fit "),
        F.format_string("%.2f", F.bround("fit", 2)), spots,
    )
    return best.join(volume, ["run_id", "cluster"]).select(
        "run_id",
        "place",
        F.col("cluster").alias("phrase"),
        "volume",
        F.when(by_count, "bing").otherwise("autocomplete").alias("volume_source"),
        "difficulty",
        "intent",
        "members",
        "score",
        reason.alias("reason"),
    )

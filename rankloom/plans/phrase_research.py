"""Phrase research: candidates to clusters to the phrases worth targeting, for every run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import candidates as c
from rankloom.operators import clusters, demand, ranks
from rankloom.operators.coverage import drop_judged
from rankloom.operators.phrases import phrase_fit
from rankloom.session import cut_lineage
from rankloom.settings import GapSettings


@dataclass(frozen=True)
class PhraseResearch:
    candidates: DataFrame  # all, with the reason they were dropped
    survivors: DataFrame
    clusters: DataFrame
    phrases: DataFrame


def expandable_seeds(scored: DataFrame, s: GapSettings) -> DataFrame:
    """The best candidates with demand, worth expanding with related keywords."""
    t = s.thresholds
    gated = demand.demand_gate(scored, t).filter("kept")
    return c.best_by_score(
        gated, c.pre_score(F.col("fit"), F.col("volume")), t.seeds_to_expand
    )


def phrase_research(
    sources: DataFrame,
    page_vectors: DataFrame,
    serp: DataFrame,
    site_ranks: DataFrame,
    s: GapSettings,
    year: int,
    unfit: DataFrame | None = None,
    free: bool = True,
) -> PhraseResearch:
    """sources: as union_candidates reads; page_vectors: run_id, vector; unfit: run_id, keyword
    rejected by a judge. In free mode difficulty is computed from the result pages."""
    t = s.thresholds
    merged = phrase_fit(c.union_candidates(sources), page_vectors)
    gated = cut_lineage(demand.demand_gate(merged, t, free))
    alive = gated.filter("kept").drop("kept", "reason")
    score = c.pre_score(
        F.col("fit"), F.col("volume"), None if free else F.col("difficulty")
    )
    best = c.best_by_score(alive, score, t.pre_rank_pool).drop("score", "place")
    profile = ranks.serp_profile(serp, site_ranks, t).withColumnRenamed("intent", "serp_intent")
    if free:
        profile = profile.withColumnRenamed("difficulty", "computed")
        joined = best.join(profile, ["run_id", "keyword"], "left").withColumn(
            "difficulty", F.coalesce("computed", F.lit(0))
        )
    else:
        joined = best.join(profile.drop("difficulty"), ["run_id", "keyword"], "left")
    joined = joined.withColumn(
        "intent",
        F.when(F.col("intent") == "unknown", F.coalesce("serp_intent", F.lit("unknown"))).otherwise(
            F.col("intent")
        ),
    )
    spots = ranks.weak_spots(
        F.coalesce("top", F.array().cast(profile.schema["top"].dataType)),
        F.coalesce("small_sites", F.lit(0)) if free else F.lit(0),
        year,
        t,
    )
    judged = cut_lineage(
        demand.difficulty_ceiling(joined.withColumn("spots", spots), s).select(
            "run_id", "keyword", "sources", "ord", "volume", "in_autocomplete", "difficulty",
            "intent", "fit", "kept", "reason", F.col("spots.signals").alias("signals"),
            F.col("spots.bonus").alias("bonus"),
        )
    )
    survivors = judged.filter("kept")
    if unfit is not None:
        survivors = drop_judged(survivors, unfit, ["run_id", "keyword"])
    leads = clusters.serp_clusters(
        survivors, serp, [-F.col("volume")], t.min_shared_urls, t.serp_top
    )
    members = survivors.join(leads, ["run_id", "keyword"])
    scores = cut_lineage(c.cluster_scores(members, survivors, s))
    phrases = c.chosen_phrases(scores, survivors, s)
    return PhraseResearch(
        candidates=_reasons(gated, judged, unfit, scores, phrases, s),
        survivors=survivors,
        clusters=scores,
        phrases=phrases,
    )


def _reasons(gated, judged, unfit, scores, phrases, s: GapSettings) -> DataFrame:
    """Every candidate with why it was dropped or chosen; the later step speaks last."""
    keys = ["run_id", "keyword"]
    t = s.thresholds
    out = gated.join(
        judged.select(*keys, F.col("reason").alias("ceiling"), F.lit(True).alias("ranked")),
        keys,
        "left",
    )
    out = out.join(
        phrases.select("run_id", F.col("phrase").alias("keyword"), F.col("reason").alias("why")),
        keys,
        "left",
    ).join(
        scores.select("run_id", F.col("cluster").alias("keyword"), F.col("score").alias("points")),
        keys,
        "left",
    )
    rejected = F.lit(None).cast("string")
    if unfit is not None:
        out = out.join(unfit.select(*keys).distinct().withColumn("no", F.lit(True)), keys, "left")
        rejected = F.when(
            F.col("no") & (F.col("ceiling") == ""), "LLM: page does not fit this phrase"
        )
    reason = F.coalesce(
        F.when(~F.col("kept"), F.col("reason")),
        F.when(F.col("ranked").isNull(), F.lit("below pre-rank cut-off")),
        F.nullif("ceiling", F.lit("")),
        rejected,
        F.concat(F.lit("chosen: "), "why"),
        F.when(
            F.col("points").isNotNull(),
            F.concat(F.lit("cluster score "), F.col("points").cast("string"),
                     F.lit(f" below top {t.phrases_per_run}")),
        ),
        F.lit(""),
    )
    return out.withColumn("reason", reason).select(
        *keys, "sources", "volume", "in_autocomplete", "fit", "reason",
        F.col("why").isNotNull().alias("chosen"),
    )

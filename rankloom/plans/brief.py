"""Brief scorecard: titles, checklist and draft checks, for every run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import brief
from rankloom.settings import Thresholds


@dataclass(frozen=True)
class BriefScorecard:
    titles: DataFrame
    checklist: DataFrame
    draft: DataFrame
    target: DataFrame


def brief_scorecard(
    titles: DataFrame,
    drafts: DataFrame,
    competitor_pages: DataFrame,
    facts: DataFrame,
    t: Thresholds,
) -> BriefScorecard:
    """titles: run_id, pos, title, description, phrase; drafts: as draft_checks reads;
    competitor_pages: run_id, words; facts: run_id, first_heading, intent_flag,
    stuffing_warnings."""
    ranked = brief.title_choices(titles, t)
    best = ranked.filter("place = 1").join(facts, "run_id", "left")
    return BriefScorecard(
        titles=ranked.select(
            "run_id",
            "place",
            F.col("check.title").alias("title"),
            F.col("check.passed").alias("passed"),
            F.col("check.reasons").alias("reasons"),
        ),
        checklist=brief.brief_checklist(best),
        draft=brief.draft_checks(drafts, t),
        target=brief.target_length(competitor_pages, t),
    )

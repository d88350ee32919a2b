"""Label columns: bands, statuses, gap categories and plain-language texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom import fixed_values as fv
from rankloom.settings import GapSettings, SnapshotSettings


def _lookup(value: Column, texts: dict, other: str) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for key, text in texts.items():
        out = out.when(value == key, text)
    return out.otherwise(other)


def band(difficulty: Column, s: GapSettings) -> Column:
    return (
        F.when(difficulty.isNull(), F.lit(None))
        .when(difficulty <= s.band_low, "low")
        .when(difficulty <= s.band_medium, "medium")
        .otherwise("high")
    )


def competition(difficulty: Column) -> Column:
    return F.when(difficulty <= 30, "Low").when(difficulty <= 55, "Medium").otherwise("High")


def verdict(score: Column) -> Column:
    return (
        F.when(score >= 70, "Strong").when(score >= 40, "Getting there").otherwise("Needs work")
    )


def vital_status(metric: Column, p75: Column, s: SnapshotSettings) -> Column:
    """Null for a metric without limits."""
    out = F.when(F.lit(False), F.lit(""))
    for name, (good, poor) in s.vitals.items():
        grade = F.when(p75 <= good, "good").when(p75 > poor, "poor").otherwise("needs work")
        out = out.when(metric == name, grade)
    return out


def demand_status(searches: Column, has_source: Column) -> Column:
    return (
        F.when(~has_source, "no_key")
        .when(searches.isNull(), "not_measured")
        .when(searches > 0, "measured")
        .otherwise("too_low")
    )


def gap_categories(
    ours: Column, ranked: Column, competitors: Column, best: Column, worst: Column
) -> Column:
    """Overlapping categories from our position, how many of the competitors rank, and their
    best and worst positions."""
    all_rank = (competitors > 0) & (ranked == competitors)
    any_rank = ranked > 0
    we_rank = ours.isNotNull()
    return F.array_compact(
        F.array(
            F.when(we_rank & all_rank, "shared"),
            F.when(~we_rank & all_rank, "missing"),
            F.when(we_rank & any_rank & (worst < ours), "weak"),
            F.when(we_rank & any_rank & (ours < best), "strong"),
            F.when(~we_rank & any_rank, "untapped"),
            F.when(we_rank & ~any_rank, "unique"),
        )
    )


def demand_text(source: Column, volume: Column) -> Column:
    count = F.concat(F.lit("About "), F.format_number(volume, 0), F.lit(" searches a month"))
    return (
        F.when(source == "autocomplete", "People search this on Google")
        .when(source == "bing", F.concat(count, F.lit(" (Bing)")))
        .otherwise(count)
    )


def intent_text(intent: Column) -> Column:
    return _lookup(intent, fv.INTENT_TEXT, "Mixed")


def fit_text(fit: Column) -> Column:
    return _lookup(fit, fv.FIT_TEXT, "Not judged")


def searches_text(status: Column, searches: Column) -> Column:
    return (
        F.when(status == "measured", F.format_number(F.coalesce(searches, F.lit(0)), 0))
        .when(status == "too_low", "Too low")
        .when(status == "not_measured", "Not measured")
        .otherwise("No Bing key")
    )

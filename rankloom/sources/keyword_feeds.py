"""Keyword feeds: landed JSON answers to demand, suggestion and ranked-keyword rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import normalise_phrase

_DATA = (
    "keyword:string,keyword_info:struct<search_volume:int>,"
    "keyword_properties:struct<keyword_difficulty:int>,"
    "search_intent_info:struct<main_intent:string>"
)
_ITEMS = f"items array<struct<{_DATA}>>"
_RANKED = (
    f"items array<struct<keyword_data:struct<{_DATA}>,"
    "ranked_serp_element:struct<serp_item:struct<rank_group:int,url:string>>>>"
)


def _numbers(x: Column) -> list[Column]:
    return [
        F.coalesce(x["keyword"], F.lit("")).alias("keyword"),
        F.coalesce(x["keyword_info"]["search_volume"], F.lit(0)).alias("volume"),
        x["keyword_properties"]["keyword_difficulty"].alias("difficulty"),
        F.coalesce(
            F.nullif(x["search_intent_info"]["main_intent"], F.lit("")), F.lit("unknown")
        ).alias("intent"),
    ]


def keyword_overview(raw: DataFrame, wanted: DataFrame) -> DataFrame:
    """Answers (body) for the wanted keywords (keyword); a keyword without data has volume 0."""
    found = raw.select(F.posexplode(F.from_json("body", _ITEMS)["items"]).alias("i", "x")).select(
        "i", *_numbers(F.col("x"))
    )
    last = (
        found.groupBy(normalise_phrase(F.col("keyword")).alias("keyword"))
        .agg(F.max(F.struct("i", "volume", "difficulty", "intent")).alias("m"))
    )
    asked = (
        wanted.select(normalise_phrase(F.col("keyword")).alias("keyword"))
        .filter("keyword <> ''")
        .distinct()
    )
    return asked.join(last, "keyword", "left").select(
        "keyword",
        F.coalesce("m.volume", F.lit(0)).alias("volume"),
        F.col("m.difficulty").alias("difficulty"),
        F.coalesce("m.intent", F.lit("unknown")).alias("intent"),
    )


def keyword_suggestions(raw: DataFrame) -> DataFrame:
    """(phrase, body) -> suggested keywords with their numbers, in feed order."""
    return raw.select(
        "phrase", F.posexplode(F.from_json("body", _ITEMS)["items"]).alias("pos", "x")
    ).select("phrase", "pos", *_numbers(F.col("x")))


def ranked_keywords(raw: DataFrame) -> DataFrame:
    """(target, body) -> the keywords a page or site ranks for."""
    rows = raw.select(
        "target", F.posexplode(F.from_json("body", _RANKED)["items"]).alias("pos", "x")
    )
    item = F.col("x.ranked_serp_element.serp_item")
    return rows.select(
        "target",
        "pos",
        *_numbers(F.col("x.keyword_data")),
        F.coalesce(item["rank_group"], F.lit(0)).alias("rank"),
        F.coalesce(item["url"], F.lit("")).alias("url"),
    )


def suggestions(raw: DataFrame) -> DataFrame:
    """(phrase, body) suggestion feed -> distinct suggestions in order."""
    values = F.transform(
        F.from_json("body", "items array<struct<suggestion:string>>")["items"],
        lambda x: x["suggestion"],
    )
    kept = F.array_distinct(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != ""))
    return raw.select("phrase", F.posexplode(kept).alias("pos", "suggestion"))


def suggestion_lists(raw: DataFrame) -> DataFrame:
    """(keyword, body) of the plain suggestion endpoint, `["phrase", ["s1", ...]]`, to
    (keyword, list): normalised, distinct, in order. A null body stays a null list."""
    inner = F.from_json(F.get_json_object("body", "$[1]"), "array<string>")
    empty = F.array().cast("array<string>")
    values = F.array_distinct(F.transform(F.coalesce(inner, empty), normalise_phrase))
    return raw.select("keyword", F.when(F.col("body").isNotNull(), values).alias("list"))


def wcf_date(text: Column) -> Column:
    """Date of "/Date(1790380800000)/"; null for anything else."""
    ms = F.regexp_extract(text, r"^/Date\((-?\d+)", 1)
    return F.to_date(F.timestamp_millis(F.nullif(ms, F.lit("")).cast("long")))


def weekly_impressions(raw: DataFrame) -> DataFrame:
    """(keyword, country, body) -> one row per week with impressions."""
    rows = F.from_json("body", "d array<struct<Date:string,Impressions:int>>")["d"]
    return (
        raw.select("keyword", "country", F.inline(rows))
        .select(
            "keyword",
            "country",
            wcf_date(F.col("Date")).alias("week_date"),
            F.coalesce("Impressions", F.lit(0)).alias("impressions"),
        )
        .filter(F.col("week_date").isNotNull())
    )

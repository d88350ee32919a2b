"""Site facts: rank lists, link index, link scores, page speed and domain dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import fixed_values as fv


def read_rank_list(spark: SparkSession, path: str) -> DataFrame:
    """CSV lines `rank,domain` -> (domain, rank); the best rank wins on duplicates."""
    rows = spark.read.schema("rank string, domain string").csv(path)
    return (
        rows.select(
            F.lower(F.trim("domain")).alias("domain"), F.expr("try_cast(rank AS int)").alias("rank")
        )
        .filter(F.col("rank").isNotNull() & (F.coalesce("domain", F.lit("")) != ""))
        .groupBy("domain")
        .agg(F.min("rank").alias("rank"))
    )


def read_link_index(spark: SparkSession, path: str) -> DataFrame:
    """Link index CSV, columns found by name; malformed rows are skipped, an empty file is an
    error."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    number = lambda c: F.expr(f"try_cast(trim(`{c}`) AS long)")
    rows = raw.select(
        F.lower(F.trim("Domain")).alias("domain"),
        number("GlobalRank").alias("global_rank"),
        number("RefSubNets").alias("ref_subnets"),
        number("RefIPs").alias("ref_ips"),
    ).dropna()
    if rows.isEmpty():
        raise ValueError(f"no usable rows in the link index at {path}")
    return rows


_LINK = (
    "found:boolean,open_page_rank:double,rank:long,referring_domains:long,"
    "history:array<struct<date:string,open_page_rank:double,estimated:boolean>>"
)


def link_scores(raw: DataFrame) -> DataFrame:
    """(domain, body) -> status, score, rank and referring domains."""
    x = F.from_json("body", f"struct<{_LINK}>")
    found = F.coalesce(F.col("x.found"), F.lit(False))
    return raw.withColumn("x", x).select(
        "domain",
        F.when(found, "ok").otherwise("not_found").alias("status"),
        F.when(found, F.col("x.open_page_rank")).alias("score"),
        F.when(found, F.col("x.rank")).alias("rank"),
        F.when(found, F.col("x.referring_domains")).alias("referring_domains"),
    )


def link_history(raw: DataFrame) -> DataFrame:
    """(domain, body) -> one row per month with a score."""
    x = F.from_json("body", f"struct<{_LINK}>")
    return (
        raw.withColumn("x", x)
        .filter("x.found")
        .select("domain", F.inline("x.history"))
        .filter(F.col("open_page_rank").isNotNull())
        .select(
            "domain",
            F.to_date("date").alias("month"),
            F.col("open_page_rank").alias("score"),
            F.coalesce("estimated", F.lit(False)).alias("estimated"),
        )
    )


_DAY = "struct<year:int,month:int,day:int>"
_VITALS = (
    "record:struct<metrics:map<string,struct<percentiles:struct<p75:string>>>,"
    f"collectionPeriod:struct<firstDate:{_DAY},lastDate:{_DAY}>>"
)


def web_vitals(raw: DataFrame) -> DataFrame:
    """(origin, form_factor, body) -> one row per metric with a number; numbers in text are read,
    other values skipped."""
    rows = raw.withColumn("r", F.from_json("body", f"struct<{_VITALS}>")["record"])

    def day(name: str):
        d = f"r.collectionPeriod.{name}"
        return F.expr(
            f"cast(try_make_timestamp_ntz({d}.year, {d}.month, {d}.day, 0, 0, 0) AS date)"
        )

    return (
        rows.select(
            "origin",
            "form_factor",
            F.explode("r.metrics").alias("metric", "value"),
            day("firstDate").alias("first_day"),
            day("lastDate").alias("last_day"),
        )
        .withColumn("p75", F.expr("try_cast(value.percentiles.p75 AS double)"))
        .filter(F.col("metric").isin(fv.VITALS_METRICS) & F.col("p75").isNotNull())
        .drop("value")
    )


def vitals_status(raw: DataFrame, vitals: DataFrame) -> DataFrame:
    """Per origin: ok, or no_data when no metric could be read."""
    have = vitals.groupBy("origin", "form_factor").agg(F.count("*").alias("n"))
    return raw.select("origin", "form_factor").join(have, ["origin", "form_factor"], "left").select(
        "origin",
        "form_factor",
        F.when(F.col("n") > 0, "ok").otherwise("no_data").alias("status"),
    )


def registration_dates(raw: DataFrame) -> DataFrame:
    """(domain, body) -> date of the first registration event; null when it cannot be read."""
    events = F.from_json("body", "events array<struct<eventAction:string,eventDate:string>>")
    first = F.try_element_at(
        F.filter(events["events"], lambda e: e["eventAction"] == "registration"), F.lit(1)
    )
    return raw.select(
        "domain", F.try_to_timestamp(first["eventDate"]).cast("date").alias("registered")
    )


def first_captures(raw: DataFrame) -> DataFrame:
    """(domain, body) -> the first readable capture after the header row: date and URL."""
    rows = F.from_json("body", "array<array<string>>")
    readable = F.filter(
        F.slice(rows, F.lit(2), F.size(rows)),
        lambda r: (F.size(r) >= 2)
        & F.try_to_timestamp(F.substring(F.element_at(r, 1), 1, 8), F.lit("yyyyMMdd")).isNotNull(),
    )
    first = F.try_element_at(readable, F.lit(1))
    return raw.select(
        "domain",
        F.try_to_timestamp(
            F.substring(F.try_element_at(first, F.lit(1)), 1, 8), F.lit("yyyyMMdd")
        ).cast("date").alias("first_seen"),
        F.try_element_at(first, F.lit(2)).alias("first_seen_url"),
    )


def registry_servers(raw: DataFrame) -> DataFrame:
    """(body) of the bootstrap file -> (tld, server): the first https address, first entry wins."""
    services = F.from_json("body", "services array<array<array<string>>>")["services"]
    rows = raw.select(F.posexplode(services).alias("i", "s")).filter(F.size("s") >= 2)
    secure = F.filter(F.element_at("s", 2), lambda u: F.startswith(u, F.lit("https://")))
    return (
        rows.withColumn("url", F.try_element_at(secure, F.lit(1)))
        .filter(F.col("url").isNotNull())
        .select("i", "url", F.explode(F.element_at("s", 1)).alias("tld"))
        .groupBy(F.lower("tld").alias("tld"))
        .agg(F.min_by("url", "i").alias("url"))
        .select("tld", F.concat(F.regexp_replace("url", "/+$", ""), F.lit("/")).alias("server"))
    )

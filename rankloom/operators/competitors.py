"""Competitor pages: pooled results, ordered filters with one reason per dropped page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rankloom import fixed_values as fv
from rankloom.functions.url import domain_of, in_domains, url_key
from rankloom.session import cut_lineage
from rankloom.settings import Thresholds


def pool_results(serp: DataFrame, phrase_ord: str = "phrase_ord") -> DataFrame:
    """Results of several phrases of a run, one row per overlap key at its best rank; the first
    phrase wins ties."""
    rest = [c for c in serp.columns if c not in ("run_id", "rank", phrase_ord, "pos")]
    row = F.struct("rank", F.col(phrase_ord).alias("phrase_ord"), "pos", *rest)
    return (
        serp.groupBy("run_id", url_key(F.col("url")).alias("url_key"))
        .agg(F.min(row).alias("best"))
        .select("run_id", "url_key", "best.*")
    )


def type_mix(pages: DataFrame) -> DataFrame:
    """Pages per type and run, with the place of the first one for ties."""
    return pages.groupBy("run_id", "page_type").agg(
        F.count("*").alias("pages"), F.min(F.struct("rank", "url")).alias("first")
    )


def types_to_keep(mix: DataFrame, ours: DataFrame, t: Thresholds) -> DataFrame:
    """(run_id, page_type) kept: ours if there are enough of it, else the dominant types are added
    until there are. `mix` comes from type_mix, `ours` is (run_id, our_type). The windows run over
    a dozen rows per run."""
    joined = mix.join(ours, "run_id").withColumn(
        "mine", (F.col("page_type") == F.col("our_type")).cast("int")
    )
    order = W.partitionBy("run_id").orderBy(F.desc("mine"), F.desc("pages"), "first")
    before = F.coalesce(
        F.sum("pages").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    return (
        joined.withColumn("before", before)
        .filter((F.col("mine") == 1) | (F.col("before") < t.competitors_min))
        .select("run_id", "page_type", "pages")
    )


def competitor_cascade(
    pooled: DataFrame, pages: DataFrame, ours: DataFrame, t: Thresholds
) -> DataFrame:
    """Every pooled result with `reason` null when it is kept.

    pooled: run_id, url_key, rank, url, page_type from the result list; pages: url, read_type,
    words, status of fetched pages; ours: run_id, our_type. Filters run in a fixed order and the
    first one that drops a page names the reason: authority, format, unreadable page, format as
    read, page type, length, domain limit, page cap.
    """
    domain = domain_of(F.col("url"))
    first = F.when(
        in_domains(domain, fv.AUTHORITY_DOMAINS),
        F.concat(F.lit("authority outlier ("), domain, F.lit(")")),
    ).when(
        F.col("page_type").isin(fv.WRONG_FORMAT_TYPES),
        F.concat(F.lit("wrong format ("), F.col("page_type"), F.lit(")")),
    )
    base = pooled.select("run_id", "url_key", "rank", "url", "page_type").withColumns(
        {"domain": domain, "reason": first}
    )
    open_ = F.col("reason").isNull()
    fetched = base.join(pages.select("url", "read_type", "words", "status"), "url", "left")
    fetch_reason = F.when(
        F.coalesce("status", F.lit("http_error")) != "ok",
        F.concat(F.lit("fetch "), F.coalesce("status", F.lit("http_error"))),
    ).when(
        F.col("read_type").isin(fv.WRONG_FORMAT_TYPES),
        F.concat(F.lit("wrong format ("), F.col("read_type"), F.lit(")")),
    )
    # each stage is read by its own statistics and by the next stage, so it is written once
    read = cut_lineage(
        fetched.withColumn("reason", F.when(open_, fetch_reason).otherwise(F.col("reason")))
    )

    readable = read.filter(open_).select(
        "run_id", F.col("read_type").alias("page_type"), "rank", "url"
    )
    keep = types_to_keep(type_mix(readable), ours, t).select(
        "run_id", F.col("page_type").alias("read_type"), F.lit(True).alias("kept_type")
    )
    typed = (
        read.join(keep, ["run_id", "read_type"], "left")
        .withColumn(
            "reason",
            F.when(
                open_ & F.col("kept_type").isNull(),
                F.concat(F.lit("different page type ("), F.col("read_type"), F.lit(")")),
            ).otherwise(F.col("reason")),
        )
        .drop("kept_type")
    )
    medians = typed.filter(open_).groupBy("run_id").agg(F.median("words").alias("median"))
    out_of_range = ~F.col("words").between(
        F.col("median") * t.length_low, F.col("median") * t.length_high
    )
    measured = (
        typed.join(medians, "run_id", "left")
        .withColumn(
            "reason",
            F.when(
                open_ & out_of_range,
                F.concat(
                    F.lit("length outlier ("), F.col("words").cast("string"),
                    F.lit(" words; median "),
                    F.bround("median", 0).cast("long").cast("string"), F.lit(")"),
                ),
            ).otherwise(F.col("reason")),
        )
        .drop("median")
    )
    return _cap(cut_lineage(measured), t)


def _cap(rows: DataFrame, t: Thresholds) -> DataFrame:
    """Domain limit, then page cap. Both rankings are cut to their first rows before they
    shuffle; every other row learns its reason from the few kept ones."""
    open_ = F.col("reason").isNull()
    in_domain = W.partitionBy("run_id", "domain").orderBy("rank", "url")
    in_run = W.partitionBy("run_id").orderBy("rank", "url")
    kept = (
        rows.filter(open_)
        .select("run_id", "domain", "rank", "url", "url_key")
        .withColumn("dn", F.row_number().over(in_domain))
        .filter(F.col("dn") <= t.pages_per_domain)
        .withColumn("kn", F.row_number().over(in_run))
        .filter(F.col("kn") <= t.competitors_max)
    )
    flags = kept.select("run_id", "url_key", F.lit(True).alias("kept"))
    full = (
        kept.groupBy("run_id", "domain")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= t.pages_per_domain)
        .select("run_id", "domain", F.lit(True).alias("full"))
    )
    late = (
        F.when(F.col("kept"), F.lit(None))
        .when(F.col("full"), f"domain limit ({t.pages_per_domain} per domain)")
        .otherwise(f"over the {t.competitors_max}-page cap")
    )
    return (
        rows.join(flags, ["run_id", "url_key"], "left")
        .join(full, ["run_id", "domain"], "left")
        .withColumn("reason", F.when(open_, late).otherwise(F.col("reason")))
        .drop("kept", "full")
    )


def cascade_notes(cascade: DataFrame, t: Thresholds) -> DataFrame:
    """Per run: pages and domains kept, and whether they meet the targets."""
    kept = F.col("reason").isNull()
    return cascade.groupBy("run_id").agg(
        F.count_if(kept).alias("kept"),
        F.countDistinct(F.when(kept, F.col("domain"))).alias("domains"),
        (F.count_if(kept) < t.competitors_min).alias("too_few_pages"),
        (
            F.countDistinct(F.when(kept, F.col("domain"))) < t.competitors_min_domains
        ).alias("too_few_domains"),
    )

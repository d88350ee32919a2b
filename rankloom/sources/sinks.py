"""Sinks: spreadsheet-safe CSV exports and result tables per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom import fixed_values as fv


def safe_text(value: Column) -> Column:
    """A cell that a spreadsheet would run as a formula gets a leading apostrophe."""
    return F.when(value.rlike(fv.FORMULA_START), F.concat(F.lit("'"), value)).otherwise(value)


def safe_cells(df: DataFrame) -> DataFrame:
    """Every column as text: strings guarded, null as an empty cell."""
    cells = []
    for field in df.schema.fields:
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            cell = safe_text(cell)
        cells.append(F.coalesce(cell.cast("string"), F.lit("")).alias(field.name))
    return df.select(*cells)


def _joined(rows: DataFrame, name: str) -> Column:
    if name not in rows.columns:
        return F.lit("")
    return F.array_join(F.coalesce(F.col(name), F.array().cast("array<string>")), ";")


def keyword_table(rows: DataFrame, sites: int) -> DataFrame:
    """Gap rows as a flat table for any number of runs: one column per site number (0 is ours)
    for position, visits and URL."""

    def site(i: int, field: str) -> Column:
        return F.try_element_at("sites", F.lit(i + 1))[field]

    cluster = F.col("cluster") if "cluster" in rows.columns else F.col("keyword")
    return rows.select(
        "run_id",
        "keyword",
        F.array_join("categories", ";").alias("categories"),
        "business_fit",
        *[site(i, "position").alias(f"position_{i}") for i in range(sites)],
        F.col("searches").alias("bing_searches_per_month"),
        F.col("searches_status").alias("bing_status"),
        F.col("estimate").alias("google_searches_estimate"),
        *[site(i, "visits").alias(f"visits_estimate_{i}") for i in range(sites)],
        "traffic_lift",
        "difficulty",
        "difficulty_band",
        "intent",
        cluster.alias("cluster"),
        _joined(rows, "features").alias("serp_features"),
        *[site(i, "url").alias(f"ranking_url_{i}") for i in range(sites)],
        _joined(rows, "sources").alias("sources"),
    )


def keyword_csv(rows: DataFrame, run_id: str, domains: list[str]) -> DataFrame:
    """The download of one run: site columns carry the domain names, ours first."""
    table = keyword_table(rows.filter(F.col("run_id") == run_id), len(domains)).drop("run_id")
    for i, domain in enumerate(domains):
        for prefix, shown in (
            ("position", "position"),
            ("visits_estimate", "visits_estimate"),
            ("ranking_url", "ranking_url"),
        ):
            table = table.withColumnRenamed(f"{prefix}_{i}", f"{shown} {domain}")
    return safe_cells(table)


def snapshot_csv(keywords: DataFrame) -> DataFrame:
    """The snapshot download: run_id plus eleven fixed columns."""
    table = keywords.select(
        "run_id",
        "keyword",
        "position",
        "url",
        F.col("searches").alias("bing_searches_per_month"),
        F.col("searches_status").alias("bing_status"),
        F.col("estimate").alias("google_searches_estimate"),
        F.col("visits").alias("visits_estimate"),
        "difficulty",
        "difficulty_band",
        "intent",
        _joined(keywords, "features").alias("serp_features"),
    )
    return safe_cells(table)


def write_csv(table: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = table.write.mode("overwrite").option("header", True).option("emptyValue", "")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def save_runs(results: DataFrame, path: str) -> None:
    """Append finished runs to the result table; kind and run_date become folders."""
    dated = results.withColumn("run_date", F.to_date("created_at"))
    dated.write.mode("append").partitionBy("kind", "run_date").parquet(path)


def public_rows(results: DataFrame, *hidden: str) -> DataFrame:
    """Result rows without large text columns; nested fields are named `column.field`."""
    for name in hidden:
        if "." in name:
            column, field = name.split(".", 1)
            results = results.withColumn(column, F.col(column).dropFields(field))
        else:
            results = results.drop(name)
    return results


def list_runs(results: DataFrame, offset: int = 0, size: int | None = None) -> DataFrame:
    """Newest runs first, with the columns a listing shows; one page of them where a size is given."""
    shown = [
        c
        for c in ("run_id", "kind", "created_at", "status", "title", "to_add", "cost_usd")
        if c in results.columns
    ]
    ordered = results.select(*shown).orderBy(F.desc("created_at"), "run_id")
    page = ordered.offset(offset) if offset else ordered
    return page if size is None else page.limit(size)


def gap_title(domain: Column, competitors: Column) -> Column:
    return F.concat(
        domain,
        F.lit(" vs "),
        competitors.cast("string"),
        F.when(competitors == 1, " competitor").otherwise(" competitors"),
    )

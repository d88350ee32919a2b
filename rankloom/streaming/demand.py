"""Monthly demand on a stream of impression events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.numeric import half_even_int
from rankloom.session import scratch_path


def windowed_demand(
    events: DataFrame, late: str = "7 days", start: str = "0 days", weeks: int = 12
) -> DataFrame:
    """events (ts, keyword, impressions) -> (keyword, today, impressions, searches): twelve-week
    windows that move by a week. A window [start, end) ends the day after `today`. Events later
    than the watermark are dropped; works on a stream and on a batch alike."""
    window = F.window("ts", f"{weeks * 7} days", "7 days", start)
    total = F.sum("impressions")
    monthly = total / F.lit(float(weeks)) * F.lit(52 / 12)
    return (
        events.withWatermark("ts", late)
        .groupBy(window.alias("w"), "keyword")
        .agg(total.alias("impressions"), half_even_int(monthly).alias("searches"))
        .select(
            "keyword",
            F.date_sub(F.to_date("w.end"), 1).alias("today"),
            "impressions",
            "searches",
        )
    )


def numbered_schema(stream: DataFrame) -> T.StructType:
    """The stream's columns plus the micro-batch folder they were written under."""
    return T.StructType([*stream.schema.fields, T.StructField("batch_id", T.IntegerType())])


def run_available(stream: DataFrame, keys: list[str], path: str | None = None) -> DataFrame:
    """Run a streaming aggregation over everything that has arrived, then stop.

    Each micro-batch writes the rows it changed under its batch number, so a retried batch
    replaces itself; reading keeps the newest version of every key. Progress and state live in
    the shared scratch folder.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    out = f"{path}/rows"

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={number}")

    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .foreachBatch(land)
        .start()
    )
    query.awaitTermination()
    landed = spark.read.schema(numbered_schema(stream)).parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    return (
        landed.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "batch_id").alias("row"))
        .select(*keys, "row.*")
    )

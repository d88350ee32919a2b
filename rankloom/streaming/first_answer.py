"""First answer per request and day wins: the contract of a daily answer cache, as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.session import scratch_path

KEYS = ["namespace", "request", "day"]


def with_request_key(answers: DataFrame, namespace: str, inputs: list[str]) -> DataFrame:
    """Adds namespace, request (a hash of the inputs) and day. answers needs `ts`."""
    return answers.withColumns(
        {
            "namespace": F.col(namespace),
            "request": F.sha2(F.to_json(F.struct(*inputs)), 256),
            "day": F.to_date("ts"),
        }
    )


def land_first_answers(
    stream: DataFrame, order: list[str], path: str | None = None, late_days: int = 1
) -> DataFrame:
    """Keep the first answer of each key in a table: earliest arrival batch, then `order` within a
    batch. The table is the state, a folder per day and batch: a micro-batch reads the folders of the
    days it holds, no other, and a retried batch replaces its own. Answers of days more than
    `late_days` before the newest day of earlier batches come too late and are dropped, so a day's
    state isn't read again once that time has passed."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "answers")
    table, newest = f"{path}/rows", f"{path}/newest"
    schema = T.StructType([f for f in stream.schema.fields if f.name != "day"])
    landed = T.StructType([*schema.fields, T.StructField("day", T.DateType()), T.StructField("batch_id", T.IntegerType())])
    days = T.StructType([T.StructField("newest", T.DateType()), T.StructField("batch_id", T.IntegerType())])

    def land(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read for its days and for its rows
        try:
            seen = None
            if number > 0:
                seen = spark.read.schema(days).parquet(newest).filter(F.col("batch_id") < number).agg(F.max("newest")).first()[0]
            last = batch.agg(F.max("day")).first()[0]
            batch.sparkSession.createDataFrame([(max(filter(None, (seen, last)), default=None),)], "newest date").write.mode(
                "overwrite"
            ).parquet(f"{newest}/batch_id={number}")
            on_time = batch if seen is None else batch.filter(F.col("day") >= F.date_sub(F.lit(seen), late_days))
            rest = [c for c in batch.columns if c not in KEYS]
            firsts = (
                on_time.groupBy(*KEYS)
                .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
                .select(*KEYS, "row.*")
            )
            held = [r["day"] for r in on_time.select("day").distinct().collect()]  # late_days bounds them
            if number > 0 and held:
                earlier = days_read(spark.read.schema(landed).parquet(table), held).filter(F.col("batch_id") < number)
                firsts = firsts.join(earlier.select(*KEYS), KEYS, "left_anti")
            firsts.withColumn("batch_id", F.lit(number)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("day", "batch_id").parquet(table)
        finally:
            batch.unpersist()

    query = (
        stream.writeStream.option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .foreachBatch(land)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(landed).parquet(table).select(*stream.columns)


def days_read(table: DataFrame, days: list) -> DataFrame:
    """The folders of some days; a filter on the folder name, so that no other is opened."""
    return table.filter(F.col("day").isin(days))

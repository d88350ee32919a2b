"""The first answer of a day over several micro-batches, a restart and late events."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from rankloom.streaming.first_answer import days_read, land_first_answers, with_request_key

SCHEMA = "ns string, q string, answer string, seq int, ts timestamp"


def at(day, hour=0):
    return dt.datetime(2024, 5, day, hour)


def run(spark, folder, state):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
    keyed = with_request_key(stream, "ns", ["q"]).select("namespace", "request", "day", "q", "answer", "seq", "ts")
    rows = land_first_answers(keyed, ["ts", "seq"], state).collect()
    return {(r["namespace"], r["q"], r["day"].day): r["answer"] for r in rows}, len(rows)


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_first_answer_wins_over_batches_restarts_and_late_events(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    folder, state = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    add(spark, folder, [("a", "x", "one", 2, at(1, 5)), ("a", "x", "two", 1, at(1, 5)), ("a", "y", "three", 1, at(1))])
    assert run(spark, folder, state) == ({("a", "x", 1): "two", ("a", "y", 1): "three"}, 2)
    # an earlier time in a later batch does not win; a new day and namespace are keys of their own
    add(spark, folder, [("a", "x", "four", 1, at(1, 1)), ("a", "x", "five", 1, at(2)), ("b", "x", "six", 1, at(2))])
    want = {("a", "x", 1): "two", ("a", "y", 1): "three", ("a", "x", 2): "five", ("b", "x", 2): "six"}
    assert run(spark, folder, state) == (want, 4)
    # a restart with nothing new changes nothing
    assert run(spark, folder, state) == (want, 4)
    # one day late still counts, more does not once a newer day was seen
    add(spark, folder, [("c", "z", "seven", 1, at(9))])
    assert run(spark, folder, state)[1] == 5
    add(spark, folder, [("c", "late", "eight", 1, at(8)), ("c", "late", "nine", 1, at(7)), ("a", "x", "ten", 1, at(1))])
    got, n = run(spark, folder, state)
    assert n == 6 and got["c", "late", 8] == "eight" and got["a", "x", 1] == "two"


def test_a_batch_opens_only_the_folders_of_its_days(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"
    rows = spark.range(50).select(F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int")).alias("day"), "id")
    rows.write.partitionBy("day").parquet(folder)
    some = days_read(spark.read.parquet(folder), [dt.date(2024, 1, 3), dt.date(2024, 1, 4)])
    assert some.count() == 2
    assert "PartitionFilters: [day" in some._jdf.queryExecution().executedPlan().toString()

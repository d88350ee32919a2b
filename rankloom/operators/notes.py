"""Notes of a run: counts worth telling the reader, as text rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.settings import GapSettings


def run_notes(rows: DataFrame, results_seen: DataFrame, s: GapSettings) -> DataFrame:
    """(run_id, note) from gap rows and (run_id, keyword, results) of the searches made."""
    unknown_demand = F.col("searches_status") != "measured"
    ranked = F.exists("sites", lambda x: x["position"].isNotNull())
    pages = -(-s.depth // 10)
    where = f"first {pages} pages" if pages > 1 else "first page"
    counts = rows.groupBy("run_id").agg(
        F.count("*").alias("n"),
        F.count_if(~unknown_demand).alias("measured"),
        F.count_if(F.col("difficulty").isNull()).alias("few"),
        F.count_if(~ranked).alias("unranked"),
    )
    empty = results_seen.groupBy("run_id").agg(
        F.count_if(F.col("results") == 0).alias("empty")
    )
    num = lambda c: F.col(c).cast("string")
    texts = F.array_compact(
        F.array(
            F.when(
                F.col("empty") > 0,
                F.concat(num("empty"), F.lit(" keyword(s) returned no Google results")),
            ),
            F.when(
                F.col("measured") < F.col("n"),
                F.concat(
                    F.lit("visits shown for "), num("measured"), F.lit(" of "), num("n"),
                    F.lit(" keywords; Bing has no numbers for the others"),
                ),
            ),
            F.when(
                F.col("few") > 0,
                F.concat(
                    num("few"),
                    F.lit(f" keyword(s) had fewer than {s.min_results} results: no difficulty"),
                ),
            ),
            F.when(
                F.col("unranked") > 0,
                F.concat(
                    num("unranked"),
                    F.lit(f" checked keyword(s): none of the sites is on the {where}"),
                ),
            ),
        )
    )
    return counts.join(empty, "run_id", "left").select("run_id", F.explode(texts).alias("note"))


def missing_searches(wanted: DataFrame, serp: DataFrame) -> DataFrame:
    """(run_id, keyword, results): results that came back per wanted keyword, 0 included."""
    seen = serp.groupBy("run_id", "keyword").agg(F.count("*").alias("seen"))
    return wanted.join(seen, ["run_id", "keyword"], "left").select(
        "run_id", "keyword", F.coalesce("seen", F.lit(0)).alias("results")
    )

from collections import Counter

from pyspark.sql import functions as F

from rankloom.functions.text import sentence_grams
from rankloom.operators import phrases
from rankloom.settings import Thresholds


def test_grams_of_a_page_in_several_rows_are_counted_together_and_not_shuffled(spark):
    rows = [("r", 1, "red bolt. red bolt, blue nut"), ("r", 1, "Red bolt"), ("r", 2, None), ("r", 3, "the 12"), ("s", 1, "blue nut")]
    df = spark.createDataFrame(rows, "run_id string, page long, text string")
    found = phrases.ngrams(df, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    got = Counter((r["run_id"], r["page"], r["gram"], r["n"], r["place"]) for r in found.collect())
    assert got == Counter([("r", 1, "red bolt", 3, 1), ("r", 1, "blue nut", 1, 2), ("s", 1, "blue nut", 1, 1)])
    assert plan.count("Exchange") == 1 and "Window" not in plan


def test_grams_of_a_text_are_those_of_the_column_and_no_lambdas_make_them(spark):
    texts = [
        "The client portal. Portal for 24 clients", "a 12 b 3d x-ray c&a u.s. r+d 007", "one\ntwo (three) four|five;six",
        "12 34", "", "  ", "ÉCOLE İstanbul ΣΑΣ naïve café", "state of the art of war", "of the", "x", "x y", "o'neill's +1 -2 a.b.c.d e",
    ]
    df = spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)], "run_id string, page long, text string")
    rows = df.select("text", F.lower("text").alias("low"), sentence_grams(F.col("text")).alias("grams")).collect()
    assert all(Counter(phrases.grams_of(r["low"])) == Counter(r["grams"]) for r in rows)
    plan = phrases.ngrams(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "lambdafunction" not in plan


def test_page_phrases_shuffle_texts_and_vectors_but_no_grams(spark):
    rows = [("r", 1, "red bolt, blue nut. red bolts 12 of a blue nuts"), ("r", 2, "the 12"), ("r", 3, None), ("s", 4, "state of the art")]
    df = spark.createDataFrame(rows, "run_id string, page long, text string")
    found = phrases.page_phrases(df, Thresholds(page_phrases=3))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "gram#" not in plan
    got = {(r["page"], r["place"]): r["phrase"] for r in found.collect()}
    assert {page for page, _ in got} == {"1", "4"} and got["4", 1] == "state of the art" and len(got) == 4
    grams = ["red bolts", "bolt of bolts", "gas tax", "us"]
    column = spark.createDataFrame([(i, g) for i, g in enumerate(grams)], "i int, g string")
    for r in column.select("i", phrases.dense(phrases.hashed_entries(F.col("g"))).alias("v")).collect():
        assert list(phrases.gram_vectors(grams)[r["i"]]) == r["v"]

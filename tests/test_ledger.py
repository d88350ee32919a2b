from decimal import Decimal

from rankloom.operators import ledger


def test_totals_beyond_a_trillion(spark):
    rows = [(1, 1, "a", Decimal("900000000000.5")), (1, 2, "a", Decimal("900000000000.25"))]
    df = spark.createDataFrame(rows, "run_id long, seq long, label string, usd decimal(18,6)")
    totals = ledger.cost_rollup(df).filter("level = 3").collect()
    assert [(r["usd"], r["calls"]) for r in totals] == [(Decimal("1800000000000.75"), 2)]
    running = ledger.running_cost(df, 2).orderBy("seq").collect()
    assert running[1]["running_usd"] == Decimal("1800000000000.75")

"""Pages of long listings, merged passes and the walk over landed sitemaps."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rankloom.operators.listing import write_listing
from rankloom.operators.passes import merge_passes, refresh
from rankloom.sources.sitemaps import reachable_entries


def test_pages_follow_the_order_and_open_few_folders(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, *range(40)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(6)
    table = write_listing(df, [F.col("v").desc_nulls_last(), F.col("k").asc()], parts=30)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert table.total == 3000 and len(table.starts) > 10
    for number in (0, 1, 57, 119, 120):
        page = table.page(number).collect()
        assert [(r["k"], r["v"]) for r in page] == want[25 * number : 25 * number + 25]
        assert [r["place"] for r in page] == list(range(25 * number + 1, 25 * number + 1 + len(page)))
    assert [r["k"] for r in table.after(1234, 3).collect()] == [k for k, _ in want[1234:1237]]
    scanned = table.page(57)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#", scanned), scanned
    assert write_listing(df.limit(0), [F.col("k").asc()]).page(0).count() == 0


def test_the_first_pass_wins_and_only_touched_runs_are_computed(spark):
    first = spark.createDataFrame([("r", "a", 1), ("s", "a", 2)], "run_id string, keyword string, n int")
    second = spark.createDataFrame([("r", "a", 9), ("r", "b", 3), ("r", "b", 2)], "run_id string, keyword string, n int")
    merged = merge_passes([first, second], ["run_id", "keyword"])
    assert {tuple(r) for r in merged.collect()} == {("r", "a", 1, 1), ("s", "a", 1, 2), ("r", "b", 2, 2)}
    previous = spark.createDataFrame([("r", 1.0), ("s", 5.0)], "run_id string, total double")
    other = spark.createDataFrame([(1,)], "x int")

    def compute(rows, whole):
        assert whole.count() == 1
        return rows.groupBy("run_id").agg(F.sum("n").cast("double").alias("total"))

    got = refresh(previous, [merged, other], merged.filter("pass = 2"), compute)
    assert {tuple(r) for r in got.collect()} == {("r", 3.0), ("s", 5.0)}


@pytest.mark.parametrize("depth", [1, 7])
def test_sitemaps_are_followed_to_any_depth(spark, depth):
    base = "https://a.com/"
    locs = lambda tag, urls: "".join(f"<{tag}><loc>{u}</loc></{tag}>" for u in urls)
    files = [("a.com", f"{base}i{k}.xml", f"<sitemapindex>{locs('sitemap', [f'{base}i{k + 1}.xml', f'{base}i0.xml'])}</sitemapindex>") for k in range(depth)]
    files += [
        ("a.com", f"{base}i{depth}.xml", f"<sitemapindex>{locs('sitemap', [f'{base}pages.xml', f'{base}gone.xml', 'https://b.com/x.xml', f'{base}tag-1.xml'])}</sitemapindex>"),
        ("a.com", f"{base}pages.xml", f"<urlset>{locs('url', ['https://a.com/1', 'https://a.com/2'])}</urlset>"),
        ("a.com", f"{base}tag-1.xml", f"<urlset>{locs('url', ['https://a.com/t'])}</urlset>"),
        ("a.com", f"{base}lone.xml", f"<urlset>{locs('url', ['https://a.com/3'])}</urlset>"),
        ("b.com", "https://b.com/x.xml", f"<urlset>{locs('url', ['https://b.com/1'])}</urlset>"),
    ]
    df = spark.createDataFrame(files, "site string, file string, content string")
    roots = spark.createDataFrame([("a.com", f"{base}i0.xml"), ("b.com", "https://b.com/none.xml")], "site string, file string")
    assert sorted(r["url"] for r in reachable_entries(df, roots).collect()) == ["https://a.com/1", "https://a.com/2"]

"""Registered queries against their SQL on the smallest tables, where both are present."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
NAMES = [
    "gap_top_keywords", "rank_check", "suggested_competitors", "keyword_csv_pivot", "weak_spots",
    "serp_overlap", "top_pages", "page_sample", "site_checks", "variant_merge", "ngrams",
    "topic_counts", "competitor_cascade", "serp_feed", "sitemap_xml", "running_cost",
    "demand_stream", "daily_first_answers",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="generated tables not here")


def plain(value):
    return round(value, 9) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = entry_point.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = con.execute(entry_point.oracle_sql()[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == columns
    at = [order.index(c) for c in columns]
    want = Counter(tuple(plain(row[i]) for i in at) for row in cursor.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())

from pyspark.sql import functions as F

from rankloom.operators import candidates
from rankloom.operators.demand import related_demand
from rankloom.plans.discovery import discover_keywords, second_pass
from rankloom.settings import GapSettings, Thresholds

S = GapSettings(keywords=10)


def test_discovery_and_second_pass(spark):
    sites = spark.createDataFrame(
        [("r", 0, "zeto.com"), ("r", 1, "rival.io")], "run_id string, ord int, domain string"
    )
    pages = [
        ("zeto.com", "https://zeto.com/a", 1, 0, "Client portals", "page"),
        ("zeto.com", "https://zeto.com/b", 2, 0, "zeto pricing", "page"),
        ("zeto.com", "https://zeto.com/c", 3, 0, "unknown thing", "page"),
        ("rival.io", "https://rival.io/a", 1, 0, "portal for client", "page"),
        ("rival.io", "https://rival.io/b", 2, 0, "file sharing", "page"),
        ("rival.io", "https://rival.io/b", 2, 1, "secure file sharing", "page alternative"),
        ("rival.io", "https://rival.io/c", 3, 0, "career page", "page"),
    ]
    page_keywords = spark.createDataFrame(
        [("r", *p) for p in pages],
        "run_id string, domain string, url string, pos int, kind_pos int, keyword string, kind string",
    )
    volumes = spark.createDataFrame(
        [("client portals", 50), ("file sharing", 20), ("secure file sharing", 0), ("career page", 90),
         ("client portal online", 12)],
        "keyword string, searches int",
    )
    lists = spark.createDataFrame(
        [(k, [k + " now"] if k == "secure file sharing" else [])
         for k in ("client portals", "file sharing", "secure file sharing", "career page", "unknown thing")],
        "keyword string, list array<string>",
    )
    related = related_demand(
        spark.createDataFrame(
            [("client portals", 0, "portal client login", 90), ("client portals", 1, "client portal app", 90),
             ("client portals", 2, "teams app", 900), ("client portals", 3, "zeto client portal", 99)],
            "phrase string, pos int, suggestion string, impressions int",
        ),
        20,
    )
    fits = spark.createDataFrame(
        [("r", "client portals", 3), ("r", "file sharing", 1), ("r", "career page", 0)],
        "run_id string, keyword string, fit int",
    )
    found = discover_keywords(page_keywords, sites, volumes, lists, related, fits, S)
    picked = [r["keyword"] for r in found.picked.orderBy("picked").collect()]
    # ours first, then the rival's own, then related, then the loose fit; unfit and unsearched go
    assert picked == ["client portals", "secure file sharing", "client portal app", "file sharing"]
    pool = {r["keyword"]: r for r in found.pool.collect()}
    assert pool["zeto pricing"]["brand_of"] == "zeto.com"
    assert pool["zeto client portal"]["brand_of"] == "zeto.com" and "teams app" not in pool
    assert [p["domain"] for p in pool["client portals"]["pages"]] == ["zeto.com", "rival.io"]
    assert pool["client portal app"]["searches"] == 30
    counts = found.counts.collect()[0]
    assert (counts["candidates"], counts["branded"], counts["no_demand"], counts["no_fit"]) == (8, 2, 1, 1)
    assert [r["keyword"] for r in found.missed.collect()] == ["unknown thing"]

    searches = spark.createDataFrame(
        [("r", "file sharing", 0, "client portal online"), ("r", "file sharing", 1, "clients portal"),
         ("r", "file sharing", 2, "zeto app"), ("r", "career page", 0, "never proven")],
        "run_id string, keyword string, pos int, query string",
    )
    rankings = spark.createDataFrame(
        [("r", "file sharing", 1, True), ("r", "career page", 2, False)],
        "run_id string, keyword string, ord int, proven boolean",
    )
    more = second_pass(searches, rankings, found, volumes, None, None, S)
    assert [r["keyword"] for r in more.collect()] == ["client portal online"]
    assert more.select(F.col("sources")[0]).collect()[0][0] == "related search"


def test_question_variants_never_broadcast_exploded_lists(spark):
    seeds = spark.createDataFrame([("r", "kw")], "run_id string, keyword string")
    lists = spark.createDataFrame([("best kw", 0, "Best KW  now"), ("best kw", 1, "best kw now"), ("x", 0, "y")], "phrase string, pos int, suggestion string")
    found = candidates.question_variants(seeds, lists, Thresholds())
    assert "Broadcast" not in found._jdf.queryExecution().toString()
    assert [(r["keyword"], r["suggestion"]) for r in found.collect()] == [("kw", "best kw now")]

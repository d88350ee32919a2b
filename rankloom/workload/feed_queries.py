"""Feed parsing, files, ledger, brief and streaming queries on data derived from the tables."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.numeric import token_cost
from rankloom.operators import brief, ledger, snapshot
from rankloom.session import scratch_path, spread
from rankloom.settings import SnapshotSettings
from rankloom.sources import keyword_feeds, serp_feeds, sinks, site_facts, sitemaps
from rankloom.streaming import demand as stream_demand
from rankloom.streaming import first_answer
from rankloom.workload import views as v
from rankloom.workload.registry import query
from rankloom.workload.views_sql import T, rounded, sql, width_sql


def answer_pages(spark: SparkSession, d: str) -> DataFrame:
    """Result lists written as paged JSON answers, ten per page, with the last result of page one
    repeated at the top of page two."""
    rows = v.serp(spark, d).filter("pos <= 20")
    item = F.struct(
        "pos",
        ((F.col("pos") - 1) % 10 + 1).alias("position"),
        F.col("url").alias("link"),
        "title",
        F.lit("text").alias("snippet"),
    )
    doubled = rows.withColumn(
        "page",
        F.explode(
            F.when(F.col("pos") == 10, F.array(F.lit(1), F.lit(2))).otherwise(
                F.array(F.when(F.col("pos") <= 10, 1).otherwise(2))
            )
        ),
    )
    lists = doubled.groupBy("run_id", "keyword", "page").agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )
    organic = F.transform(
        "items",
        lambda x: F.struct(
            x["position"].alias("position"), x["link"].alias("link"), x["title"].alias("title"),
            x["snippet"].alias("snippet"),
        ),
    )
    asked = F.array(F.struct(F.concat(F.lit("what is "), "keyword").alias("question")))
    body = F.to_json(
        F.struct(
            organic.alias("organic"),
            asked.alias("peopleAlsoAsk"),
            F.array(F.struct(F.col("keyword").alias("query"))).alias("relatedSearches"),
            F.when(F.length("keyword") % 2 == 0, F.array(F.lit("v"))).alias("videos"),
        )
    )
    return lists.select("run_id", "keyword", "page", body.alias("body"))


@query(
    "serp_feed",
    sql(
        "serp",
        body="SELECT run_id, keyword, pos, rank, url, domain, title, page_type FROM serp",
    ),
)
def serp_feed(spark, d):
    return serp_feeds.result_pages(answer_pages(spark, d), 20).drop("description")


@query(
    "serp_feed_features",
    sql(
        "serp",
        body="""SELECT run_id, keyword, string_agg(f, ';' ORDER BY o) AS features FROM (
          SELECT DISTINCT run_id, keyword, o, f FROM serp, (VALUES (1, 'people_also_ask'),
            (2, 'related_searches'), (3, 'video')) x(o, f)
          WHERE o < 3 OR length(keyword) % 2 = 0) GROUP BY 1, 2""",
    ),
)
def serp_feed_features(spark, d):
    rows = serp_feeds.page_features(answer_pages(spark, d))
    return rows.groupBy("run_id", "keyword").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("pos", "feature"))), lambda x: x["feature"]
            ),
            ";",
        ).alias("features")
    )


@query(
    "serp_feed_questions",
    sql(
        "serp",
        body="""SELECT DISTINCT run_id, keyword, 'what is ' || keyword AS question,
        keyword AS query FROM serp""",
    ),
)
def serp_feed_questions(spark, d):
    raw = answer_pages(spark, d)
    return (
        serp_feeds.page_questions(raw)
        .drop("pos")
        .join(serp_feeds.page_related(raw).drop("pos"), ["run_id", "keyword"])
    )


def mixed_feed(spark, d) -> DataFrame:
    item = F.struct(
        "pos", F.lit("organic").alias("type"), F.col("rank").alias("rank_group"), "url", "domain",
        "title", F.lit("text").alias("description"),
    )
    lists = v.serp(spark, d).groupBy("run_id", "keyword").agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )
    asked = F.to_json(F.array(F.struct(F.concat(F.lit("why "), "keyword").alias("title"))))
    organic = F.transform(
        "items",
        lambda x: F.to_json(
            F.struct(x["type"].alias("type"), x["rank_group"].alias("rank_group"),
                     x["url"].alias("url"), x["domain"].alias("domain"), x["title"].alias("title"))
        ),
    )
    paa = F.concat(F.lit('{"type":"people_also_ask","items":'), asked, F.lit("}"))
    related = F.concat(
        F.lit('{"type":"related_searches","items":'), F.to_json(F.array("keyword")), F.lit("}")
    )
    body = F.concat(
        F.lit('{"items":['), paa, F.lit(","), F.array_join(organic, ","), F.lit(","), related,
        F.lit("]}"),
    )
    return lists.select("run_id", "keyword", body.alias("body"))


@query(
    "mixed_result_feed",
    sql(
        "serp",
        body="SELECT run_id, keyword, pos, rank, url, domain, title, page_type FROM serp "
        "WHERE pos <= 10",
    ),
)
def mixed_result_feed(spark, d):
    return serp_feeds.feed_results(mixed_feed(spark, d), 10).drop("description")


@query(
    "mixed_feed_extras",
    sql(
        "serp",
        body="""SELECT DISTINCT run_id, keyword, 'why ' || keyword AS question, keyword AS query,
        'people_also_ask;related_searches' AS features FROM serp""",
    ),
)
def mixed_feed_extras(spark, d):
    raw = mixed_feed(spark, d)
    keys = ["run_id", "keyword"]
    kinds = (
        serp_feeds.feed_features(raw)
        .groupBy(*keys)
        .agg(F.array_join(F.array_sort(F.collect_list("feature")), ";").alias("features"))
    )
    return (
        serp_feeds.feed_questions(raw)
        .drop("pos")
        .join(serp_feeds.feed_related(raw).drop("pos"), keys)
        .join(kinds, keys)
    )


@query(
    "cited_pages",
    sql(
        "serp",
        body="""SELECT run_id, keyword, CAST(row_number() OVER (PARTITION BY run_id, keyword
          ORDER BY pos) AS INTEGER) AS rank, url, domain FROM serp WHERE pos % 3 <> 0""",
    ),
)
def cited_pages(spark, d):
    """Every third citation is an unresolved redirect, and each list is cited twice."""
    chunk = F.struct(
        "pos",
        F.when(
            F.col("pos") % 3 == 0,
            F.concat(F.lit("https://vertexaisearch.cloud.google.com/r/"), "keyword"),
        )
        .otherwise(F.col("url"))
        .alias("uri"),
        "title",
    )
    lists = v.serp(spark, d).groupBy("run_id", "keyword").agg(
        F.array_sort(F.collect_list(chunk)).alias("items")
    )
    chunks = F.transform(
        F.concat("items", "items"),
        lambda x: F.struct(
            F.struct(x["uri"].alias("uri"), x["title"].alias("title")).alias("web")
        ),
    )
    body = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.struct(chunks.alias("groundingChunks")).alias("groundingMetadata")
                )
            ).alias("candidates")
        )
    )
    raw = lists.select("run_id", "keyword", body.alias("body"))
    return serp_feeds.cited_pages(raw, 20).select("run_id", "keyword", "rank", "url", "domain")


@query(
    "keyword_overview",
    """SELECT p_partkey || ' kw' AS keyword, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END
      AS volume, CASE WHEN p_partkey % 3 = 0 AND p_size > 10 THEN p_size END AS difficulty,
      CASE WHEN p_partkey % 3 = 0 THEN 'commercial' ELSE 'unknown' END AS intent FROM part""",
)
def keyword_overview(spark, d):
    kw = F.concat(F.col("p_partkey").cast("string"), F.lit(" KW"))
    parts = v.table(spark, d, "part")
    item = F.struct(
        kw.alias("keyword"),
        F.struct(F.col("p_size").alias("search_volume")).alias("keyword_info"),
        F.struct(F.when(F.col("p_size") > 10, F.col("p_size")).alias("keyword_difficulty")).alias(
            "keyword_properties"
        ),
        F.struct(F.lit("commercial").alias("main_intent")).alias("search_intent_info"),
    )
    raw = parts.filter("p_partkey % 3 = 0").select(
        F.to_json(F.struct(F.array(item).alias("items"))).alias("body")
    )
    return keyword_feeds.keyword_overview(raw, parts.select(kw.alias("keyword")))


@query(
    "suggestion_feed",
    """SELECT p_name AS phrase, count(DISTINCT p_type) AS suggestions FROM part GROUP BY 1""",
)
def suggestion_feed(spark, d):
    lists = v.table(spark, d, "part").groupBy("p_name").agg(
        F.collect_set(F.struct(F.concat_ws(" ", "p_name", "p_type").alias("suggestion"))).alias("i")
    )
    raw = lists.select(
        F.col("p_name").alias("phrase"),
        F.to_json(F.struct(F.concat("i", "i").alias("items"))).alias("body"),
    )
    return keyword_feeds.suggestions(raw).groupBy("phrase").agg(F.count("*").alias("suggestions"))


@query(
    "weekly_feed",
    sql("impressions", body="SELECT CAST(ord AS VARCHAR) AS keyword, week_date, impressions FROM impressions"),
)
def weekly_feed(spark, d):
    ms = F.unix_millis(F.col("week_date").cast("timestamp"))
    row = F.struct(
        F.concat(F.lit("/Date("), ms.cast("string"), F.lit(")/")).alias("Date"),
        F.col("impressions").alias("Impressions"),
    )
    raw = (
        v.impressions(spark, d)
        .groupBy("ord")
        .agg(F.to_json(F.struct(F.collect_list(row).alias("d"))).alias("body"))
        .select(F.col("ord").cast("string").alias("keyword"), F.lit("US").alias("country"), "body")
    )
    return keyword_feeds.weekly_impressions(raw).drop("country")


@query(
    "sitemap_xml",
    sql("sitemap", body="SELECT site, url, lastmod FROM sitemap"),
)
def sitemap_xml(spark, d):
    """Each site's pages written as a namespaced sitemap file, then parsed."""
    safe = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    entry = F.concat(
        F.lit("<sm:url><sm:loc> "), safe, F.lit(" </sm:loc><sm:lastmod>"), "lastmod",
        F.lit("</sm:lastmod></sm:url>"),
    )
    files = (
        v.sitemap(spark, d)
        .groupBy("site")
        .agg(F.array_join(F.collect_list(entry), "").alias("urls"))
        .select(
            "site",
            F.lit("/sitemap.xml").alias("file"),
            F.concat(
                F.lit('<?xml version="1.0"?><sm:urlset xmlns:sm="http://www.sitemaps.org/s">'),
                "urls", F.lit("<sm:url><sm:loc></sm:loc></sm:url></sm:urlset>"),
            ).alias("content"),
        )
    )
    return sitemaps.sitemap_entries(files).select("site", "url", "lastmod")


def _sitemap_files(spark, d) -> DataFrame:
    """A tree of landed files per site: page lists of 64 pages at most, every second one packed, two
    indexes over them, a root index over these. The second index lists itself and the root again, and a
    list of images; every fifth page list is listed nowhere."""
    leaf = F.floor(F.col("pos") / 64)
    base = F.concat(F.lit("https://"), "site", F.lit("/"))
    safe = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    entry = F.concat(F.lit("<url><loc>"), safe, F.lit("</loc><lastmod>"), "lastmod", F.lit("</lastmod></url>"))
    lists = (
        v.sitemap(spark, d)
        .groupBy("site", leaf.alias("leaf"))
        .agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("content"))
        .select("site", "leaf", F.concat(base, F.lit("page-sitemap-"), F.col("leaf").cast("string"), F.lit(".xml")).alias("file"), "content")
    )

    @F.pandas_udf("binary")
    def packed(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: gzip.compress(x.encode()))

    landed = lists.select(
        "site", "file", F.when(F.col("leaf") % 2 == 1, packed("content")).otherwise(F.col("content").cast("binary")).alias("bytes")
    )

    def index(children) -> Column:
        locs = F.transform(children, lambda c: F.concat(F.lit("<sitemap><loc>"), c, F.lit("</loc></sitemap>")))
        return F.concat(F.lit("<sitemapindex>"), F.array_join(locs, ""), F.lit("</sitemapindex>")).cast("binary")

    name = lambda n: F.concat(base, F.lit("index-"), n.cast("string"), F.lit(".xml"))
    half = F.col("leaf") % 2
    extra = F.when(
        half == 1, F.array(name(F.lit(1)), F.concat(base, F.lit("sitemap.xml")), F.concat(base, F.lit("image-sitemap.xml")))
    ).otherwise(F.array().cast("array<string>"))
    middle = (
        lists.filter("leaf % 5 < 4")
        .groupBy("site", half.alias("leaf"))
        .agg(F.collect_list("file").alias("children"))
        .select("site", name(half).alias("file"), index(F.concat("children", extra)).alias("bytes"))
    )
    roots = lists.select("site").distinct().select(
        "site", F.concat(base, F.lit("sitemap.xml")).alias("file"), index(F.array(name(F.lit(0)), name(F.lit(1)))).alias("bytes")
    )
    return landed.unionByName(middle).unionByName(roots)


@query(
    "sitemap_tree",
    sql("sitemap", body="SELECT site, url, lastmod FROM sitemap WHERE (pos // 64) % 5 < 4"),
)
def sitemap_tree(spark, d):
    files = _sitemap_files(spark, d)
    roots = files.filter(F.endswith("file", F.lit("/sitemap.xml"))).select("site", "file")
    texts = files.select("site", "file", sitemaps.unpack(F.col("bytes")).alias("content"))
    return sitemaps.reachable_entries(texts, roots).select("site", "url", "lastmod")


@query("sitemap_files", sql("sitemap", body="SELECT url, lastmod FROM sitemap"))
def sitemap_files(spark, d):
    """The page lists written as files and read by the XML source."""
    path = scratch_path(spark, "sitemaps")
    files = _sitemap_files(spark, d).filter(F.contains("file", F.lit("page-sitemap")))
    texts = files.select(sitemaps.unpack(F.col("bytes")).alias("value"))
    texts.write.option("maxRecordsPerFile", 1).text(path)
    return sitemaps.read_sitemap_files(spark, path)


@query("rank_list_csv", sql("site_ranks", body="SELECT domain, CAST(rank AS INTEGER) AS rank FROM site_ranks"))
def rank_list_csv(spark, d):
    """The rank list written as CSV with duplicates in other case and worse rank, read back."""
    ranks = v.site_ranks(spark, d).select("rank", F.upper("domain").alias("domain"))
    worse = ranks.withColumn("rank", F.col("rank") + 5)
    path = scratch_path(spark, "ranks")
    ranks.union(worse).write.csv(path)
    return site_facts.read_rank_list(spark, path)


@query(
    "link_index_csv",
    """SELECT 's' || s_suppkey AS domain, s_suppkey AS global_rank, CAST(s_nationkey AS BIGINT)
      AS ref_subnets, CAST(s_nationkey * 2 AS BIGINT) AS ref_ips FROM supplier
    WHERE s_suppkey % 10 <> 3""",
)
def link_index_csv(spark, d):
    k = F.col("s_suppkey")
    rows = v.table(spark, d, "supplier").select(
        F.when(k % 10 == 3, F.lit("n/a")).otherwise(k.cast("string")).alias("GlobalRank"),
        F.concat(F.lit("S"), k.cast("string")).alias("Domain"),
        F.col("s_nationkey").alias("RefSubNets"),
        (F.col("s_nationkey") * 2).alias("RefIPs"),
    )
    path = scratch_path(spark, "links")
    rows.write.option("header", True).csv(path)
    return site_facts.read_link_index(spark, path)


def _link_raw(spark, d) -> DataFrame:
    point = F.struct(
        F.date_format(F.col("month"), "yyyy-MM-dd").alias("date"),
        F.col("n").cast("double").alias("open_page_rank"),
        F.lit(False).alias("estimated"),
    )
    months = (
        v.table(spark, d, "orders")
        .groupBy("o_custkey", F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"))
        .agg(F.count("*").alias("n"))
    )
    return (
        months.groupBy("o_custkey")
        .agg(F.collect_list(point).alias("history"), F.sum("n").alias("total"))
        .select(
            F.col("o_custkey").cast("string").alias("domain"),
            F.to_json(
                F.struct(
                    (F.col("o_custkey") % 7 > 0).alias("found"),
                    F.col("total").cast("double").alias("open_page_rank"),
                    "history",
                )
            ).alias("body"),
        )
    )


_MONTHS = """WITH m AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
  count(*) AS n FROM orders WHERE o_custkey % 7 > 0 GROUP BY 1, 2)"""


@query(
    "link_scores",
    """SELECT CAST(o_custkey AS VARCHAR) AS domain,
      CASE WHEN o_custkey % 7 > 0 THEN 'ok' ELSE 'not_found' END AS status,
      CASE WHEN o_custkey % 7 > 0 THEN CAST(count(*) AS DOUBLE) END AS score
    FROM orders GROUP BY o_custkey""",
)
def link_scores(spark, d):
    return site_facts.link_scores(_link_raw(spark, d)).select("domain", "status", "score")


@query(
    "link_history_recent",
    f"""{_MONTHS} SELECT CAST(o_custkey AS VARCHAR) AS domain, month, CAST(n AS DOUBLE) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY month DESC) AS r FROM m)
    WHERE r <= 3""",
)
def link_history_recent(spark, d):
    history = site_facts.link_history(_link_raw(spark, d))
    return snapshot.recent_history(history, 3).drop("estimated")


def _vital_raw(spark, d) -> DataFrame:
    """One record per user: their event values as page-speed numbers, layout shift as text."""
    value = F.col("value")
    stats = v.table(spark, d, "events").groupBy("user_id").agg(
        F.max(value * 10).alias("lcp"),
        F.max(value).alias("inp"),
        F.min(value / 100).alias("cls"),
    )
    metric = lambda c: F.struct(F.struct(c.alias("p75")).alias("percentiles"))
    record = F.struct(
        F.struct(
            metric(F.col("lcp").cast("string")).alias("largest_contentful_paint"),
            metric(F.when(F.col("user_id") % 5 == 0, "n/a").otherwise(F.col("inp").cast("string")))
            .alias("interaction_to_next_paint"),
            metric(F.col("cls").cast("string")).alias("cumulative_layout_shift"),
        ).alias("metrics")
    )
    return stats.select(
        F.col("user_id").cast("string").alias("origin"),
        F.lit("PHONE").alias("form_factor"),
        F.to_json(F.struct(record.alias("record"))).alias("body"),
    )


@query(
    "web_vitals",
    """WITH s AS (SELECT user_id, max(value * 10) AS lcp, max(value) AS inp, min(value / 100) AS cls
      FROM events GROUP BY 1),
    u AS (SELECT user_id, 'largest_contentful_paint' AS metric, lcp AS p75, 2500 AS good, 4000 AS poor
      FROM s UNION ALL SELECT user_id, 'interaction_to_next_paint', inp, 200, 500 FROM s
      WHERE user_id % 5 <> 0 UNION ALL SELECT user_id, 'cumulative_layout_shift', cls, 0.1, 0.25
      FROM s)
    SELECT CAST(user_id AS VARCHAR) AS origin, metric, round(p75, 6) AS p75,
      CASE WHEN p75 <= good THEN 'good' WHEN p75 > poor THEN 'poor' ELSE 'needs work' END AS status
    FROM u""",
)
def web_vitals(spark, d):
    rows = site_facts.web_vitals(_vital_raw(spark, d))
    return snapshot.vital_results(rows, SnapshotSettings()).select(
        "origin", "metric", F.round("p75", 6).alias("p75"), "status"
    )


@query(
    "domain_dates",
    """SELECT CAST(o_custkey AS VARCHAR) AS domain, CAST(min(o_orderdate) AS DATE) AS registered,
      CAST(max(o_orderdate) AS DATE) AS first_seen FROM orders GROUP BY 1""",
)
def domain_dates(spark, d):
    spans = v.table(spark, d, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")
    )
    domain = F.col("o_custkey").cast("string").alias("domain")
    event = lambda kind, c: F.struct(
        F.lit(kind).alias("eventAction"),
        F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("eventDate"),
    )
    registry = spans.select(
        domain,
        F.to_json(
            F.struct(
                F.array(event("last changed", F.col("b")), event("registration", F.col("a"))).alias(
                    "events"
                )
            )
        ).alias("body"),
    )
    rows = F.array(
        F.array(F.lit("timestamp"), F.lit("original")),
        F.array(F.lit("bad"), F.lit("x")),
        F.array(F.date_format("b", "yyyyMMddHHmmss"), F.lit("http://x/")),
    )
    archive = spans.select(domain, F.to_json(rows).alias("body"))
    return site_facts.registration_dates(registry).join(
        site_facts.first_captures(archive).select("domain", "first_seen"), "domain"
    )


# --- ledger and sinks --------------------------------------------------------------------------


@query(
    "cost_rollup",
    """SELECT o_custkey AS run_id, o_orderpriority AS label,
      CAST(sum(CAST(o_totalprice AS DECIMAL(18,6))) AS DOUBLE) AS usd, count(*) AS calls
    FROM orders GROUP BY ROLLUP (o_custkey, o_orderpriority)""",
)
def cost_rollup(spark, d):
    return (
        ledger.cost_rollup(v.ledger(spark, d))
        .drop("level")
        .withColumn("usd", F.col("usd").cast("double"))
    )


@query(
    "running_cost",
    """SELECT o_custkey AS run_id, o_orderkey AS seq, CAST(sum(CAST(o_totalprice AS DECIMAL(18,6)))
      OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS DOUBLE) AS running_usd FROM orders""",
)
def running_cost(spark, d):
    return ledger.running_cost(v.ledger(spark, d), 1000).select(
        "run_id", "seq", F.col("running_usd").cast("double").alias("running_usd")
    )


@query(
    "token_cost",
    """SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 < 2 THEN
      ((o_orderkey - o_orderkey % 50) * 0.28e0 + (o_orderkey % 50) * 0.028e0 + 7 * 0.42e0) / 1000000e0
      ELSE 0e0 END, 12) AS usd FROM orders""",
)
def token_cost_query(spark, d):
    k = F.col("o_orderkey")
    model = F.element_at(
        F.array(F.lit("deepseek-chat"), F.lit("deepseek-reasoner"), F.lit("other")),
        (k % 3 + 1).cast("int"),
    )
    return v.table(spark, d, "orders").select(
        "o_orderkey", F.round(token_cost(model, k, k % 50, F.lit(7)), 12).alias("usd")
    )


@query(
    "formula_guard",
    """SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN '''=' || role WHEN turn % 4 = 1
      THEN '''-' || role WHEN turn % 4 = 2 THEN ' =' || role ELSE role END AS cell
    FROM conversations""",
)
def formula_guard(spark, d):
    lead = F.element_at(
        F.array(*[F.lit(x) for x in ("=", "-", " =", "")]), (F.col("turn") % 4 + 1).cast("int")
    )
    return v.table(spark, d, "conversations").select(
        "conv_id", "turn", sinks.safe_text(F.concat(lead, "role")).alias("cell")
    )


@query(
    "saved_runs",
    """SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'F' THEN 'gap' ELSE 'brief' END AS kind,
      CAST(o_orderdate AS DATE) AS run_date FROM orders""",
)
def saved_runs(spark, d):
    """Runs appended to the result table and read back."""
    path = scratch_path(spark, "runs")
    runs = v.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.when(F.col("o_orderstatus") == "F", "gap").otherwise("brief").alias("kind"),
        F.date_trunc("year", "o_orderdate").alias("created_at"),
        F.to_date("o_orderdate").alias("day"),
        F.struct(F.lit("large").alias("text"), F.lit(1).alias("n")).alias("page"),
    )
    sinks.save_runs(runs, path)
    kept = sinks.public_rows(spark.read.parquet(path), "page.text")
    return kept.select("run_id", "kind", F.col("day").alias("run_date"))


# --- brief -------------------------------------------------------------------------------------


def drafts(spark, d) -> DataFrame:
    """Documents as drafts: the first line is the H1, every later line a section."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rest = F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))
    return (
        v.table(spark, d, "documents")
        .withColumn("lines", lines)
        .select(
            F.col("doc_id").alias("run_id"),
            F.lit("the").alias("phrase"),
            F.coalesce(F.try_element_at("lines", F.lit(1)), F.lit("")).alias("h1"),
            F.lit("Read [ADD: price] now").alias("intro"),
            F.transform(rest, lambda x: F.struct(F.lit("Part").alias("heading"), x.alias("body")))
            .alias("sections"),
            F.array(F.struct(F.lit("q").alias("question"), F.lit("a").alias("answer"))).alias("faq"),
            F.lit("").alias("cta"),
        )
    )


_DRAFT = rf"""l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM documents),
whole AS (SELECT doc_id, l, coalesce(l[1], '') AS h1, greatest(len(l) - 1, 0) AS sections, array_to_string(
    list_filter([coalesce(l[1], ''), 'Read [ADD: price] now']
      || flatten(list_transform(l[2:], lambda x: ['Part', x])) || ['q', 'a'], lambda p: p <> ''), chr(10)) AS text FROM l),
d AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n,
    len(regexp_extract_all(regexp_replace(lower(text), '[^\pL\pN\pM_]+', '  ', 'g'), '(?:^| )the(?: |$)')) AS uses,
    list_filter(regexp_split_to_array(h1 || ' Read [ADD: price] now', '\s+'), lambda x: x <> '')[:100] AS opening FROM whole)"""


@query(
    "draft_checks",
    f"""WITH {_DRAFT}
    SELECT doc_id AS run_id, 'Main search phrase in the H1' AS label, contains(lower(h1), 'the') AS ok, '' AS detail FROM d
    UNION ALL SELECT doc_id, 'Main phrase in the first 100 words',
      contains(lower(array_to_string(opening, ' ')), 'the'), '' FROM d
    UNION ALL SELECT doc_id, 'No keyword stuffing', 100e0 * uses / greatest(n, 1) <= {T.draft_density},
      'phrase used ' || uses || '× (' || printf('%.1f', round_even(100e0 * uses / greatest(n, 1), 1)) || ' per 100 words)' FROM d
    UNION ALL SELECT doc_id, 'Right length to compete', n BETWEEN {T.draft_min_words} AND {T.draft_max_words} * 1.2,
      n || ' words (aim for {T.draft_min_words} to {T.draft_max_words})' FROM d
    UNION ALL SELECT doc_id, 'Clear section structure', sections BETWEEN 3 AND 8, sections || ' sections' FROM d
    UNION ALL SELECT doc_id, 'FAQ answers searcher questions', FALSE, '1 questions' FROM d
    UNION ALL SELECT doc_id, 'Facts to fill in', FALSE, '1 placeholder(s) marked [ADD: …]' FROM d""",
)
def draft_checks(spark, d):
    return brief.draft_checks(drafts(spark, d), T)


@query(
    "target_length",
    f"""WITH w AS (SELECT source AS run_id, n_chars AS words FROM documents),
    m AS (SELECT run_id, list(words ORDER BY words)[count(*) // 2 + 1] AS median FROM w GROUP BY 1)
    SELECT run_id, median, least({T.draft_max_words}, greatest({T.draft_min_words}, median))
      AS target_words FROM m""",
)
def target_length(spark, d):
    pages = v.table(spark, d, "documents").select(
        F.col("source").alias("run_id"), F.col("n_chars").alias("words")
    )
    return brief.target_length(pages, T)


def _titles(spark, d) -> DataFrame:
    return spread(v.keywords(spark, d)).select(
        "run_id",
        F.col("ord").alias("pos"),
        F.concat(F.initcap("keyword"), F.lit(" for busy teams and shops")).alias("title"),
        F.repeat(F.concat(F.col("keyword"), F.lit(" ")), (F.col("ord") % 8).cast("int")).alias(
            "description"
        ),
        F.col("keyword").alias("phrase"),
    )


_TITLED = f"""
, t AS (SELECT run_id, ord AS pos, keyword AS phrase,
    array_to_string(list_transform(string_split(keyword, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')
      || ' for busy teams and shops' AS title,
    trim(repeat(keyword || ' ', CAST(ord % 8 AS INTEGER))) AS description FROM keywords),
s AS (SELECT *, CAST(ceil({width_sql('title')} * {T.title_font} / 1000.0) AS INTEGER) AS px,
    length(title) >= {T.title_chars} AS long_enough,
    length(description) BETWEEN {T.description_min} AND {T.description_max} AS description_ok,
    contains(lower(title), lower(phrase)) AS in_title, starts_with(lower(title), lower(phrase)) AS first,
    contains(lower(description[:{T.description_payoff}]), lower(phrase)) AS payoff FROM t),
judged AS (SELECT *, long_enough AND px <= {T.title_px} AS title_ok,
    long_enough AND px <= {T.title_px} AND description_ok AND in_title AS passed,
    array_to_string(list_filter([
      CASE WHEN px > {T.title_px} THEN 'title is ' || px || 'px, over {T.title_px}px; Google will truncate it' END,
      CASE WHEN NOT long_enough THEN 'title is ' || length(title) || ' chars, under {T.title_chars}; room left unused' END,
      CASE WHEN length(description) > {T.description_max} THEN 'description is ' || length(description)
        || ' chars, over {T.description_max}' END,
      CASE WHEN length(description) < {T.description_min} THEN 'description is ' || length(description)
        || ' chars, under {T.description_min}' END,
      CASE WHEN NOT in_title THEN 'phrase ''' || phrase || ''' not in title' END,
      CASE WHEN in_title AND NOT first THEN 'phrase ''' || phrase || ''' is not at the start of the title' END,
      CASE WHEN NOT payoff THEN 'phrase ''' || phrase || ''' not in first {T.description_payoff} chars of description' END],
      lambda x: x IS NOT NULL), '; ') AS reasons FROM s),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY CAST(NOT passed AS INTEGER), pos) AS INTEGER) AS place
  FROM judged)
"""


@query(
    "title_choices",
    sql("keywords", body=_TITLED + "SELECT run_id, place, title, passed, reasons FROM ranked WHERE place <= 3"),
)
def title_choices(spark, d):
    rows = brief.title_choices(_titles(spark, d), T)
    return rows.select(
        "run_id", "place", "check.title", "check.passed",
        F.array_join("check.reasons", "; ").alias("reasons"),
    )


@query(
    "brief_checklist",
    sql(
        "keywords",
        body=_TITLED + """SELECT run_id, in_title AS phrase_in_title, first AS phrase_first_in_title,
          title_ok AS title_width_ok, description_ok AS description_length_ok,
          payoff AS phrase_in_description_payoff, in_title AS phrase_in_h1, TRUE AS intent_matches, TRUE AS no_stuffing,
          CAST(in_title AS INTEGER) + CAST(first AS INTEGER) + CAST(title_ok AS INTEGER) + CAST(description_ok AS INTEGER)
            + CAST(payoff AS INTEGER) + CAST(in_title AS INTEGER) + 2 AS passed
        FROM ranked WHERE place = 1""",
    ),
)
def brief_checklist(spark, d):
    best = brief.title_choices(_titles(spark, d), T).filter("place = 1")
    return brief.brief_checklist(
        best.withColumns(
            {
                "first_heading": F.col("title"),
                "intent_flag": F.lit(None).cast("string"),
                "stuffing_warnings": F.lit(0),
            }
        )
    )


# --- streaming ---------------------------------------------------------------------------------


def event_stream(spark, d) -> DataFrame:
    schema = v.table(spark, d, "events").schema
    return (
        spark.readStream.schema(schema)
        .parquet(f"{d}/events*.parquet")
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


@query(
    "demand_stream",
    f"""WITH e AS (SELECT event_type AS keyword, CAST(floor(value) AS INTEGER) AS n,
      CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM events),
    w AS (SELECT keyword, n, unnest(range(0, 12)) AS back, day FROM e)
    SELECT keyword, CAST(DATE '1970-01-01' + CAST((day // 7) * 7 - back * 7 + 83 AS INTEGER) AS DATE)
      AS today, CAST(sum(n) AS BIGINT) AS impressions,
      {rounded('sum(n) / 12e0 * (52e0 / 12e0)')} AS searches FROM w GROUP BY 1, 2""",
)
def demand_stream(spark, d):
    events = event_stream(spark, d).select(
        "ts",
        F.col("event_type").alias("keyword"),
        F.floor("value").cast("int").alias("impressions"),
    )
    return stream_demand.run_available(
        stream_demand.windowed_demand(events), ["keyword", "today"]
    )


@query(
    "daily_first_answers",
    """SELECT event_type AS namespace, CAST(ts AS DATE) AS day,
      CAST(user_id % 10 AS BIGINT) AS topic, arg_min(event_id, {'t': ts, 'e': event_id}) AS event_id
    FROM events GROUP BY 1, 2, 3""",
)
def daily_first_answers(spark, d):
    stream = event_stream(spark, d).withColumn("topic", F.col("user_id") % 10)
    keyed = first_answer.with_request_key(stream, "event_type", ["topic"]).select(
        "namespace", "request", "day", "topic", "event_id", "ts"
    )
    firsts = first_answer.land_first_answers(keyed, ["ts", "event_id"])
    return firsts.select("namespace", "day", "topic", "event_id")

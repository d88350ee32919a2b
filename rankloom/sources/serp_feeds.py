"""Search result feeds: landed JSON answers to ranked result rows.

All parsers take (run_id, keyword, ..., body string) and read the JSON with declared schemas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rankloom import fixed_values as fv
from rankloom.functions.page_type import guess_page_type
from rankloom.functions.url import domain_of, host_of

PAGE_SIZE = 10
_PAGE = (
    "organic array<struct<position:int,link:string,title:string,snippet:string>>,"
    + ",".join(f"{key} string" for key in fv.SERP_FEATURE_KEYS)
)
_FEED = (
    "items array<struct<type:string,rank_group:int,url:string,domain:string,title:string,"
    "description:string,items:string>>"
)
_GROUNDED = (
    "candidates array<struct<groundingMetadata:struct<"
    "groundingChunks:array<struct<web:struct<uri:string,title:string>>>,"
    "webSearchQueries:array<string>>>>"
)


def _present(raw: Column) -> Column:
    """A JSON value that is there and not empty."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    return ~text.isin("", "[]", "{}", "null", "false", "0", '""')


def _items(rows: DataFrame) -> DataFrame:
    title = F.coalesce("title", F.lit(""))
    return rows.select(
        "run_id",
        "keyword",
        "pos",
        "rank",
        "url",
        F.coalesce(F.nullif("domain", F.lit("")), domain_of(F.col("url"))).alias("domain"),
        title.alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        guess_page_type(F.col("url"), title).alias("page_type"),
    )


def result_pages(raw: DataFrame, n: int) -> DataFrame:
    """Paged answers (run_id, keyword, page, body) -> result rows. Ranks count from the top of the
    whole list; a URL repeated on a later page is dropped; at most n results per keyword."""
    parsed = raw.select(
        "run_id", "keyword", "page", F.from_json("body", _PAGE)["organic"].alias("organic")
    )
    hits = parsed.select(
        "run_id", "keyword", "page", F.posexplode("organic").alias("i", "o")
    ).filter(F.coalesce("o.link", F.lit("")) != "")
    place = F.coalesce(F.nullif("o.position", F.lit(0)), F.col("i") + 1)
    firsts = (
        hits.select(
            "run_id",
            "keyword",
            F.col("o.link").alias("url"),
            F.struct(
                "page",
                "i",
                ((F.col("page") - 1) * PAGE_SIZE + place).alias("rank"),
                F.col("o.title").alias("title"),
                F.col("o.snippet").alias("description"),
            ).alias("first"),
        )
        .groupBy("run_id", "keyword", "url")
        .agg(F.min("first").alias("first"))
        .select("run_id", "keyword", "url", "first.*", F.lit("").alias("domain"))
    )
    order = W.partitionBy("run_id", "keyword").orderBy("page", "i")
    ranked = firsts.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= n)
    return _items(ranked)


def page_features(raw: DataFrame) -> DataFrame:
    """(run_id, keyword, pos, feature) shown on the first page, in a fixed order."""
    first = raw.filter(F.col("page") == 1).withColumn("p", F.from_json("body", _PAGE))
    names = F.array_compact(
        F.array(
            *[
                F.when(_present(F.col("p")[key]), F.lit(name))
                for key, name in fv.SERP_FEATURE_KEYS.items()
            ]
        )
    )
    return first.select("run_id", "keyword", F.posexplode(names).alias("pos", "feature"))


def _page_list(raw: DataFrame, key: str, field: str, name: str) -> DataFrame:
    first = raw.filter(F.col("page") == 1).withColumn("p", F.from_json("body", _PAGE))
    values = F.transform(
        F.from_json(F.col("p")[key], f"array<struct<{field}:string>>"), lambda q: q[field]
    )
    kept = F.filter(values, lambda v: F.coalesce(v, F.lit("")) != "")
    return first.select("run_id", "keyword", F.posexplode(kept).alias("pos", name))


def page_questions(raw: DataFrame) -> DataFrame:
    return _page_list(raw, "peopleAlsoAsk", "question", "question")


def page_related(raw: DataFrame) -> DataFrame:
    return _page_list(raw, "relatedSearches", "query", "query")


def feed_results(raw: DataFrame, n: int) -> DataFrame:
    """One-answer feed (run_id, keyword, body) with mixed item types -> organic result rows."""
    items = F.filter(F.from_json("body", _FEED)["items"], lambda i: i["type"] == "organic")
    rows = raw.select(
        "run_id", "keyword", F.posexplode(F.slice(items, 1, n)).alias("i", "o")
    ).select(
        "run_id",
        "keyword",
        (F.col("i") + 1).alias("pos"),
        F.coalesce(F.nullif("o.rank_group", F.lit(0)), F.col("i") + 1).alias("rank"),
        "o.url",
        "o.domain",
        "o.title",
        "o.description",
    )
    return _items(rows)


def feed_features(raw: DataFrame) -> DataFrame:
    """Feature types in order of appearance, each once."""
    kinds = F.array_distinct(
        F.filter(
            F.transform(F.from_json("body", _FEED)["items"], lambda i: i["type"]),
            lambda k: (F.coalesce(k, F.lit("")) != "") & (k != "organic"),
        )
    )
    return raw.select("run_id", "keyword", F.posexplode(kinds).alias("pos", "feature"))


def feed_questions(raw: DataFrame) -> DataFrame:
    lists = F.transform(
        F.filter(F.from_json("body", _FEED)["items"], lambda i: i["type"] == "people_also_ask"),
        lambda i: F.from_json(i["items"], "array<struct<title:string>>"),
    )
    titles = F.filter(
        F.transform(F.flatten(F.array_compact(lists)), lambda q: q["title"]),
        lambda v: F.coalesce(v, F.lit("")) != "",
    )
    return raw.select("run_id", "keyword", F.posexplode(titles).alias("pos", "question"))


def feed_related(raw: DataFrame) -> DataFrame:
    lists = F.transform(
        F.filter(
            F.from_json("body", _FEED)["items"],
            lambda i: i["type"].isin("related_searches", "people_also_search"),
        ),
        lambda i: F.from_json(i["items"], "array<string>"),
    )
    queries = F.array_compact(F.flatten(F.array_compact(lists)))
    return raw.select("run_id", "keyword", F.posexplode(queries).alias("pos", "query"))


def cited_pages(raw: DataFrame, n: int, resolved: DataFrame | None = None) -> DataFrame:
    """Cited pages of a grounded answer as a result list: redirect addresses dropped, each URL
    once, ranked in citation order. `resolved` is (uri, url) when redirects were followed."""
    first = F.element_at(F.from_json("body", _GROUNDED)["candidates"], 1)
    chunks = F.filter(
        first["groundingMetadata"]["groundingChunks"],
        lambda c: F.coalesce(c["web"]["uri"], F.lit("")) != "",
    )
    cited = raw.select("run_id", "keyword", F.posexplode(chunks).alias("i", "c")).select(
        "run_id", "keyword", "i", F.col("c.web.uri").alias("uri"), F.col("c.web.title").alias("t")
    )
    if resolved is not None:
        cited = cited.join(resolved.select("uri", F.col("url").alias("to")), "uri", "left")
    else:
        cited = cited.withColumn("to", F.lit(None).cast("string"))
    pages = (
        cited.withColumn("url", F.coalesce("to", "uri"))
        .filter(host_of(F.col("url")) != fv.GROUNDING_REDIRECT_HOST)
        .groupBy("run_id", "keyword", "url")
        .agg(F.min(F.struct("i", F.col("t").alias("title"))).alias("first"))
        .select("run_id", "keyword", "url", "first.*")
    )
    order = W.partitionBy("run_id", "keyword").orderBy("i")
    ranked = pages.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= n)
    return _items(
        ranked.withColumns(
            {"rank": F.col("pos"), "domain": F.lit(""), "description": F.lit("")}
        )
    )


def cited_queries(raw: DataFrame) -> DataFrame:
    """The searches behind a grounded answer, used as related searches."""
    first = F.element_at(F.from_json("body", _GROUNDED)["candidates"], 1)
    return raw.select(
        "run_id",
        "keyword",
        F.posexplode(first["groundingMetadata"]["webSearchQueries"]).alias("pos", "query"),
    )

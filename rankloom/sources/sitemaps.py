"""Sitemap files: page lists and indexes, any namespace, gzip or plain."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.url import domain_of
from rankloom.operators.sampling import child_sitemaps
from rankloom.session import cut_lineage

_ENTRY = "array<struct<loc:string,lastmod:string>>"
_FILE = f"url {_ENTRY}, sitemap {_ENTRY}"


def read_sitemap_files(spark: SparkSession, path: str, index: bool = False) -> DataFrame:
    """(url, lastmod) of sitemap files on storage, split and parsed by the XML source; .gz files
    are unpacked by the reader. `index` reads the child list of index files instead."""
    rows = (
        spark.read.format("xml")
        .option("rowTag", "sitemap" if index else "url")
        .option("ignoreNamespace", True)
        .option("mode", "DROPMALFORMED")
        .schema("loc string, lastmod string")
        .load(path)
    )
    url = F.trim("loc")
    return rows.select(
        url.alias("url"), F.coalesce(F.trim("lastmod"), F.lit("")).alias("lastmod")
    ).filter(F.coalesce(url, F.lit("")) != "")


def unpack(content):
    """Text of landed sitemap bytes, packed or plain; damaged gzip content becomes null."""

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> str | None:
            if data is None:
                return None
            if data[:2] != b"\x1f\x8b":
                return data.decode("utf-8", "replace")
            try:
                return gzip.decompress(data).decode("utf-8", "replace")
            except (zlib.error, gzip.BadGzipFile, EOFError):
                return None

        return rows.map(one)

    return text(content)


def sitemap_entries(files: DataFrame) -> DataFrame:
    """Landed files (site, file, content string) -> (site, file, kind, pos, url, lastmod). A file
    that is not a sitemap gives no rows."""
    # prefixes such as <sm:url> are dropped with the namespace declarations
    plain = F.regexp_replace("content", r"(</?)[A-Za-z][\w.-]*:", "$1")
    root = F.regexp_extract(plain, r"<(urlset|sitemapindex)[\s>/]", 1)
    parsed = (
        files.withColumn("kind", root)
        .filter(F.col("kind") != "")
        .withColumn(
            "x",
            F.from_xml(
                plain,
                F.lit(_FILE),
                {"ignoreNamespace": "true", "mode": "PERMISSIVE", "rowTag": "ROW"},
            ),
        )
    )
    lists = F.when(F.col("kind") == "urlset", F.col("x.url")).otherwise(F.col("x.sitemap"))
    kept = F.filter(lists, lambda e: F.coalesce(F.trim(e["loc"]), F.lit("")) != "")
    return parsed.select(
        "site",
        "file",
        F.when(F.col("kind") == "urlset", "urlset").otherwise("index").alias("kind"),
        F.posexplode(kept).alias("pos", "e"),
    ).select(
        "site",
        "file",
        "kind",
        "pos",
        F.trim("e.loc").alias("url"),
        F.coalesce(F.trim("e.lastmod"), F.lit("")).alias("lastmod"),
    )


def reachable_entries(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries (site, file, pos, url, lastmod) of every page list that a site's root files reach over
    indexes, however deep. files: site, file (its address), content; roots: site, file.

    The frontier starts with the roots; each round follows the children that the frontier's indexes
    list, on the site's own domain and without those that hold no pages, and leaves out files visited
    before, so circles end. A file listed but not landed is visited and gives no rows.
    """
    entries = cut_lineage(sitemap_entries(files))
    inside = entries.filter("kind = 'index'")
    own = domain_of(F.col("url")) == F.col("site")
    edges = cut_lineage(
        child_sitemaps(inside.filter(own)).select("site", "file", F.col("url").alias("child")).distinct()
    )
    frontier = cut_lineage(roots.select("site", "file").distinct())
    visited = frontier
    while True:
        found = frontier.join(edges, ["site", "file"]).select("site", F.col("child").alias("file")).distinct()
        frontier = cut_lineage(found.join(visited, ["site", "file"], "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return entries.filter("kind = 'urlset'").drop("kind").join(visited, ["site", "file"], "left_semi")

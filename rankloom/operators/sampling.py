"""Site page sampling: which sitemap URLs to read, spread over the sections of a site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rankloom import fixed_values as fv
from rankloom.functions.binding import bind
from rankloom.functions.robots import allowed_by
from rankloom.functions.url import (
    domain_of,
    host_of,
    page_key,
    path_of,
    query_of,
    segments,
    skip_reason,
    without_fragment,
)
from rankloom.settings import GapSettings


def other_languages(entries: DataFrame, language: str) -> DataFrame:
    """(site, prefix): first path segments that are versions in another language. Only sites with
    two or more language prefixes count, so /it/ on a one-language site stays a section."""
    first = F.try_element_at(segments(F.col("url")), F.lit(1))
    prefixes = (
        entries.select("site", first.alias("prefix"))
        .filter(F.col("prefix").rlike(fv.LANGUAGE_SEGMENT))
        .distinct()
    )
    many = prefixes.groupBy("site").agg(F.count("*").alias("n")).filter(F.col("n") >= 2)
    own = F.regexp_extract("prefix", r"^([^-_]*)", 1) == language.lower()
    return prefixes.filter(~own).join(many.select("site"), "site", "left_semi")


def host_rules(rules: DataFrame, agent: str) -> DataFrame:
    """(host, rules array): the rules a crawler follows on each host, its own group if there is
    one, else the group for everyone. A robots file is at most 500 KiB, which bounds the array.

    rules: host, agent, allow, pattern.
    """
    mine = F.lower("agent") == agent.lower()
    rule = F.struct("pattern", "allow")
    per_host = rules.filter(mine | (F.col("agent") == "*")).groupBy("host").agg(
        F.collect_list(F.when(mine, rule)).alias("own"),
        F.collect_list(F.when(~mine, rule)).alias("all"),
        F.max(mine.cast("int")).alias("named"),
    )
    return per_host.select(
        "host", F.when(F.col("named") == 1, F.col("own")).otherwise(F.col("all")).alias("rules")
    )


def with_robots(
    urls: DataFrame, rules: DataFrame, agent: str, outcomes: DataFrame | None = None
) -> DataFrame:
    """Adds `allowed`. `outcomes` is (host, outcome) from robots_outcome; hosts without an outcome
    follow their rules, hosts without rules allow everything."""
    target = F.concat(
        F.when(path_of(F.col("url")) == "", "/").otherwise(path_of(F.col("url"))),
        F.when(
            query_of(F.col("url")) != "", F.concat(F.lit("?"), query_of(F.col("url")))
        ).otherwise(F.lit("")),
    )
    out = urls.withColumn("host", host_of(F.col("url"))).join(
        host_rules(rules, agent), "host", "left"
    )
    by_rule = F.when(F.col("rules").isNull(), True).otherwise(
        bind(target, lambda path: allowed_by(path, F.col("rules")))
    )
    if outcomes is None:
        return out.withColumn("allowed", by_rule).drop("rules", "host")
    return (
        out.join(outcomes, "host", "left")
        .withColumn(
            "allowed",
            F.when(F.col("outcome") == "deny_all", False)
            .when(F.col("outcome") == "allow_all", True)
            .otherwise(by_rule),
        )
        .drop("rules", "host", "outcome")
    )


def judge_urls(entries: DataFrame, s: GapSettings) -> DataFrame:
    """Adds `reason`, why an entry is not read (null keeps it). entries: site, pos, url, lastmod
    and optionally `allowed` from with_robots."""
    languages = other_languages(entries, s.language).withColumn("foreign", F.lit(True))
    first = F.try_element_at(segments(F.col("url")), F.lit(1))
    reason = F.coalesce(
        skip_reason(F.col("url"), F.col("site")),
        F.when(F.col("foreign"), F.lit("other language")),
    )
    if "allowed" in entries.columns:
        reason = F.coalesce(
            reason, F.when(~F.col("allowed"), F.lit("blocked by robots.txt"))
        )
    return (
        entries.withColumn("prefix", first)
        .join(languages, ["site", "prefix"], "left")
        .withColumn("reason", reason)
        .drop("prefix", "foreign")
    )


def skip_counts(judged: DataFrame) -> DataFrame:
    return (
        judged.filter(F.col("reason").isNotNull())
        .groupBy("site", "reason")
        .agg(F.count("*").alias("urls"))
    )


def top_up(usable: DataFrame, links: DataFrame, s: GapSettings) -> DataFrame:
    """Adds usable homepage links to sites whose sitemap gives too few pages, with the source of
    each site's pages: sitemap, links, or both. Both inputs: site, pos, url, lastmod."""
    have = usable.groupBy("site").agg(F.count("*").alias("n"))
    thin = links.join(have, "site", "left").filter(
        F.coalesce("n", F.lit(0)) < s.pages_per_site
    )
    keyed = usable.select("site", page_key(F.col("url")).alias("key")).distinct()
    extra = (
        thin.withColumn("key", page_key(F.col("url")))
        .join(keyed, ["site", "key"], "left_anti")
        .select("site", "pos", "url", "lastmod", F.lit("links").alias("origin"))
    )
    rows = usable.select("site", "pos", "url", "lastmod", F.lit("sitemap").alias("origin"))
    both = rows.unionByName(extra)
    kinds = both.groupBy("site").agg(
        F.max((F.col("origin") == "sitemap").cast("int")).alias("listed"),
        F.max((F.col("origin") == "links").cast("int")).alias("linked"),
    )
    label = (
        F.when((F.col("listed") == 1) & (F.col("linked") == 1), "sitemap+links")
        .when(F.col("listed") == 1, "sitemap")
        .otherwise("links")
    )
    return both.join(kinds.select("site", label.alias("source")), "site")


def home_urls(entries: DataFrame) -> DataFrame:
    """(site, home): the site's own spelling of its homepage, else https://site/."""
    is_home = (page_key(F.col("url")) == F.concat("site", F.lit("/"))) & (
        domain_of(F.col("url")) == F.col("site")
    )
    listed = (
        entries.groupBy("site")
        .agg(F.min_by(without_fragment(F.col("url")), F.when(is_home, F.col("pos"))).alias("h"),
             F.max(is_home.cast("int")).alias("has"))
    )
    default = F.concat(F.lit("https://"), "site", F.lit("/"))
    return listed.select(
        "site", F.when(F.col("has") == 1, F.col("h")).otherwise(default).alias("home")
    )


def select_pages(usable: DataFrame, homes: DataFrame, n: int) -> DataFrame:
    """(site, place, url): up to n pages per site, home first (a null home is left out), then
    round-robin over the sections, smallest sections first, shallow and recent pages first.

    A section can fill at most n places and only the first n sections can be reached, so each
    ranking keeps n rows per group before it shuffles, however big the site is.
    """
    entries = (
        usable.withColumn("key", page_key(F.col("url")))
        .groupBy("site", "key")
        .agg(F.min(F.struct("pos", "url", "lastmod")).alias("e"))
        .select("site", "key", "e.*")
        .join(homes, "site")
        .filter(F.col("home").isNull() | (F.col("key") != page_key(F.col("home"))))
        .withColumn("url", without_fragment(F.col("url")))
        .withColumn("depth", F.size(segments(F.col("url"))))
        .filter(F.col("home").isNotNull() | (F.col("depth") > 0))
        .withColumn(
            "section",
            F.when(F.col("depth") <= 1, "").otherwise(
                F.try_element_at(segments(F.col("url")), F.lit(1))
            ),
        )
    )
    sections = entries.groupBy("site", "section").agg(F.count("*").alias("size"))
    by_size = W.partitionBy("site").orderBy(F.col("section") != "", "size", "section")
    order = sections.withColumn("turn", F.row_number().over(by_size)).filter(F.col("turn") <= n)
    inside = W.partitionBy("site", "section").orderBy("depth", F.desc("lastmod"), "pos")
    rounds = entries.withColumn("round", F.row_number().over(inside)).filter(F.col("round") <= n)
    walk = W.partitionBy("site").orderBy("round", "turn")
    has_home = F.col("home").isNotNull().cast("int")
    picked = (
        rounds.join(order.select("site", "section", "turn"), ["site", "section"])
        .withColumn("step", F.row_number().over(walk))
        .filter(F.col("step") <= n)
        .select("site", (F.col("step") + has_home).alias("place"), "url")
        .filter(F.col("place") <= n)
    )
    first = homes.filter(F.col("home").isNotNull()).select(
        "site", F.lit(1).alias("place"), F.col("home").alias("url")
    )
    return first.unionByName(picked)


def page_totals(entries: DataFrame, judged: DataFrame) -> DataFrame:
    """Per site: distinct own pages listed, and distinct usable ones."""
    own = domain_of(F.col("url")) == F.col("site")
    key = page_key(F.col("url"))
    listed = (
        entries.filter(own)
        .select("site", key.alias("key"))
        .distinct()
        .groupBy("site")
        .agg(F.count("*").alias("listed"))
    )
    usable = (
        judged.filter(F.col("reason").isNull())
        .select("site", key.alias("key"))
        .distinct()
        .groupBy("site")
        .agg(F.count("*").alias("usable"))
    )
    sites = entries.select("site").distinct()
    return (
        sites.join(listed, "site", "left")
        .join(usable, "site", "left")
        .select(
            "site",
            F.coalesce("listed", F.lit(0)).alias("listed"),
            F.coalesce("usable", F.lit(0)).alias("usable"),
        )
    )


def child_sitemaps(index_entries: DataFrame) -> DataFrame:
    """Child files of a sitemap index in reading order: pages that sell first, posts last; tag,
    author and media files dropped. Adds `tier`; order by tier, then pos."""
    path = path_of(F.col("url"))
    tier = (
        F.when(path.rlike("(?i)" + fv.SITEMAP_FIRST), 0)
        .when(path.rlike("(?i)" + fv.SITEMAP_LAST), 2)
        .otherwise(1)
    )
    return index_entries.filter(~path.rlike("(?i)" + fv.SITEMAP_SKIP)).withColumn("tier", tier)

"""URL, sitemap, page and site-check queries over the crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import fixed_values as fv
from rankloom.functions import url as u
from rankloom.functions.page_type import guess_page_type
from rankloom.functions.robots import robots_outcome
from rankloom.functions.snippet import snippet_check
from rankloom.operators import checks, sampling
from rankloom.plans.page_sample import page_sample
from rankloom.session import spread
from rankloom.settings import GapSettings
from rankloom.sources import pages as page_source
from rankloom.workload import views as v
from rankloom.workload.registry import query
from rankloom.workload.views_sql import (
    T,
    authority,
    domain,
    host,
    in_list,
    lit,
    page_key,
    page_type,
    path,
    query_part,
    sql,
    url_key,
    width_sql,
)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "pages")


@query("page_types", f"SELECT page_id, {page_type('url')} AS page_type FROM pages")
def page_types(spark, d):
    return _pages(spark, d).select(
        "page_id", guess_page_type(F.col("url")).alias("page_type")
    )


@query(
    "url_keys",
    f"""SELECT page_id, {url_key('url')} AS url_key, {page_key('url')} AS page_key,
      {domain('url')} AS domain, split_part(url, '#', 1) AS no_fragment,
      regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', 0) AS origin,
      len(list_filter(string_split(lower({path('url')}), '/'), lambda s: s <> '')) AS depth,
      'https://' || {host('url')} AS typed_origin FROM pages""",
)
def url_keys(spark, d):
    url = F.col("url")
    return _pages(spark, d).select(
        "page_id",
        u.url_key(url).alias("url_key"),
        u.page_key(url).alias("page_key"),
        u.domain_of(url).alias("domain"),
        u.without_fragment(url).alias("no_fragment"),
        u.url_origin(url).alias("origin"),
        F.size(u.segments(url)).cast("long").alias("depth"),
        u.site_origin(url)["origin"].alias("typed_origin"),
    )


@query(
    "domain_parents",
    f"""WITH p AS (SELECT DISTINCT {domain('url')} AS domain FROM pages),
    l AS (SELECT domain, string_split(domain, '.') AS labels FROM p)
    SELECT domain, CAST(i AS INTEGER) AS level, array_to_string(labels[i + 1:], '.') AS parent,
      CASE WHEN len(labels) >= 2 THEN labels[-2] ELSE labels[1] END AS brand
    FROM l, unnest(range(0, len(labels) - 1)) AS t(i)""",
)
def domain_parents(spark, d):
    names = _pages(spark, d).select(u.domain_of(F.col("url")).alias("domain")).distinct()
    return names.select(
        "domain",
        F.posexplode(u.domain_parents(F.col("domain"))).alias("level", "parent"),
        u.brand_label(F.col("domain")).alias("brand"),
    )


@query(
    "address_variants",
    f"""WITH p AS (SELECT DISTINCT {domain('url')} AS domain FROM pages)
    SELECT domain, CAST(n AS INTEGER) AS variant_no, ['https://', 'https://www.', 'http://',
      'http://www.'][n + 1] || domain || '/' AS url FROM p, unnest(range(0, 4)) AS t(n)""",
)
def address_variants(spark, d):
    names = _pages(spark, d).select(u.domain_of(F.col("url")).alias("domain")).distinct()
    return names.select(
        "domain", F.posexplode(u.variant_urls(F.col("domain"))).alias("variant_no", "url")
    )


_SEGS = "list_filter(string_split(lower(" + path("url") + "), '/'), lambda s: s <> '')"


def _skip_sql() -> str:
    p = f"lower({path('url')})"
    ext = " OR ".join(f"ends_with({p}, {lit(e)})" for e in fv.SKIP_EXTENSIONS)
    bad = " OR ".join(
        [f"s IN {in_list(fv.SKIP_SEGMENTS)}"]
        + [f"starts_with(s, {lit(x)})" for x in fv.SKIP_PREFIXES]
        + [f"contains(s, {lit(x)})" for x in fv.SKIP_CONTAINS]
    )
    return f"""(CASE
      WHEN NOT regexp_matches(url, '^https?:') OR {domain('url')} <> site THEN 'other site'
      WHEN {query_part('url')} <> '' THEN 'query string'
      WHEN contains({p}, 'http:') OR contains({p}, 'https:') THEN 'broken link'
      WHEN {ext} OR regexp_matches({p}, {lit(fv.VERIFICATION_PATH)}) THEN 'not a web page'
      WHEN regexp_matches({p}, {lit(fv.PAGINATION_PATH)}) THEN 'pagination'
      WHEN len({_SEGS}) = 1 AND ({_SEGS})[1] IN {in_list(fv.LISTING_SECTIONS)} THEN 'list page'
      WHEN len(list_filter({_SEGS}, lambda s: {bad})) > 0 THEN
        'skipped section ''' || list_filter({_SEGS}, lambda s: {bad})[1] || ''''
      END)"""


_JUDGED = f"""
, seg AS (SELECT *, ({_SEGS})[1] AS prefix FROM sitemap),
langs AS (SELECT DISTINCT site, prefix FROM seg
  WHERE regexp_matches(prefix, {lit(fv.LANGUAGE_SEGMENT)})),
many AS (SELECT site FROM langs GROUP BY 1 HAVING count(*) >= 2),
foreign_ AS (SELECT l.site, l.prefix FROM langs l JOIN many USING (site)
  WHERE regexp_extract(l.prefix, '^([^-_]*)', 1) <> 'en'),
judged AS (SELECT s.*, coalesce({_skip_sql()},
    CASE WHEN EXISTS (SELECT 1 FROM foreign_ f WHERE f.site = s.site AND f.prefix = s.prefix)
      THEN 'other language' END) AS reason FROM seg s)
"""


@query(
    "url_skip_counts",
    sql(
        "sitemap",
        body=_JUDGED + """SELECT site, reason, count(*) AS urls FROM judged
        WHERE reason IS NOT NULL GROUP BY 1, 2""",
    ),
)
def url_skip_counts(spark, d):
    return sampling.skip_counts(sampling.judge_urls(v.sitemap(spark, d), GapSettings()))


@query("other_languages", sql("sitemap", body=_JUDGED + "SELECT site, prefix FROM foreign_"))
def other_languages(spark, d):
    return sampling.other_languages(v.sitemap(spark, d), "en")


_SAMPLE = f"""
, homes AS (SELECT site, coalesce(
    arg_min(split_part(url, '#', 1), pos) FILTER ({page_key('url')} = site || '/'
      AND {domain('url')} = site), 'https://' || site || '/') AS home FROM sitemap GROUP BY 1),
firsts AS (SELECT site, k, e.pos AS pos, split_part(e.url, '#', 1) AS url, e.lastmod AS lastmod
  FROM (SELECT site, {page_key('url')} AS k,
      min({{'pos': pos, 'url': url, 'lastmod': lastmod}}) AS e
    FROM judged WHERE reason IS NULL GROUP BY 1, 2)),
entries AS (SELECT f.*, len({_SEGS.replace('url', 'f.url')}) AS depth,
    CASE WHEN len({_SEGS.replace('url', 'f.url')}) <= 1 THEN ''
      ELSE ({_SEGS.replace('url', 'f.url')})[1] END AS section
  FROM firsts f JOIN homes h USING (site) WHERE f.k <> {page_key('h.home')}),
sections AS (SELECT site, section, row_number() OVER (PARTITION BY site
    ORDER BY section <> '', count(*), section) AS turn FROM entries GROUP BY 1, 2),
walk AS (SELECT e.site, e.url, t.turn, row_number() OVER (PARTITION BY e.site, e.section
    ORDER BY depth, lastmod DESC, pos) AS round FROM entries e JOIN sections t USING (site, section)),
steps AS (SELECT site, url, 1 + row_number() OVER (PARTITION BY site ORDER BY round, turn) AS place
  FROM walk)
"""


@query(
    "page_sample",
    sql(
        "sitemap",
        body=_JUDGED + _SAMPLE + """SELECT site, CAST(place AS INTEGER) AS place, url FROM steps
        WHERE place <= 30 UNION ALL SELECT site, 1, home FROM homes""",
    ),
)
def sample_pages(spark, d):
    return page_sample(v.sitemap(spark, d), GapSettings()).pages


@query(
    "sitemap_totals",
    sql(
        "sitemap",
        body=_JUDGED + f"""SELECT site,
          count(DISTINCT {page_key('url')}) FILTER ({domain('url')} = site) AS listed,
          count(DISTINCT {page_key('url')}) FILTER (reason IS NULL) AS usable
        FROM judged GROUP BY 1""",
    ),
)
def sitemap_totals(spark, d):
    return page_sample(v.sitemap(spark, d), GapSettings()).totals


def _robot_rules(spark, d) -> DataFrame:
    """Rules per host: a language folder is closed, numbers starting with 7 are closed but 77 is
    open, and .html pages are closed for one named crawler."""
    hosts = _pages(spark, d).select(u.host_of(F.col("url")).alias("host")).distinct()
    listed = [("*", False, "/fr/"), ("*", False, "/*/7"), ("*", True, "/*/77"),
              ("RankBot", False, "/*.html$")]
    rules = F.array(
        *[
            F.struct(F.lit(a).alias("agent"), F.lit(b).alias("allow"), F.lit(p).alias("pattern"))
            for a, b, p in listed
        ]
    )
    return hosts.filter(F.length("host") % 2 == 0).select("host", F.inline(rules))


@query(
    "robots_filter",
    f"""SELECT page_id, CASE WHEN length({host('url')}) % 2 = 1 THEN TRUE
      WHEN regexp_matches({path('url')}, '^/.*/77') THEN TRUE
      WHEN starts_with({path('url')}, '/fr/') THEN FALSE
      WHEN regexp_matches({path('url')}, '^/.*/7') THEN FALSE ELSE TRUE END AS for_all,
      CASE WHEN length({host('url')}) % 2 = 1 THEN TRUE
      ELSE NOT regexp_matches(split_part(url, '#', 1), '\\.html$') END AS for_bot FROM pages""",
)
def robots_filter(spark, d):
    rules = _robot_rules(spark, d)
    base = _pages(spark, d).select("page_id", "url")
    everyone = sampling.with_robots(base, rules, "*").select(
        "page_id", F.col("allowed").alias("for_all")
    )
    bot = sampling.with_robots(base, rules, "RankBot").select(
        "page_id", F.col("allowed").alias("for_bot")
    )
    return everyone.join(bot, "page_id")


@query(
    "robots_outcomes",
    """SELECT o_orderkey, CASE WHEN c IS NULL OR c >= 500 OR c = 429 OR big THEN 'deny_all'
      WHEN c IN (401, 403) THEN 'deny_all' WHEN c >= 400 THEN 'allow_all' ELSE 'rules' END AS outcome
    FROM (SELECT o_orderkey, o_orderkey % 50 = 7 AS big,
      [200, 301, 401, 403, 404, 410, 429, 500, NULL][o_orderkey % 9 + 1] AS c FROM orders)""",
)
def robots_outcomes(spark, d):
    codes = F.array(*[F.lit(c) for c in (200, 301, 401, 403, 404, 410, 429, 500)])
    n = (F.col("o_orderkey") % 9 + 1).cast("int")
    return v.table(spark, d, "orders").select(
        "o_orderkey",
        robots_outcome(F.try_element_at(codes, n), F.col("o_orderkey") % 50 == 7).alias("outcome"),
    )


@query(
    "sitemap_top_up",
    sql(
        "sitemap",
        body=_JUDGED + f"""
, usable AS (SELECT * FROM judged WHERE reason IS NULL AND pos % 3 = 0),
have AS (SELECT site, count(*) AS n FROM usable GROUP BY 1),
extra AS (SELECT j.* FROM judged j LEFT JOIN have USING (site)
  WHERE j.reason IS NULL AND j.pos % 3 = 1 AND coalesce(have.n, 0) < 30 AND NOT EXISTS (
    SELECT 1 FROM usable x WHERE x.site = j.site
      AND {page_key('x.url')} = {page_key('j.url')})),
both_ AS (SELECT site, pos, 'sitemap' AS origin FROM usable
  UNION ALL SELECT site, pos, 'links' FROM extra)
SELECT site, count(*) AS pages, CASE WHEN count(DISTINCT origin) = 2 THEN 'sitemap+links'
  ELSE max(origin) END AS source FROM both_ GROUP BY 1""",
    ),
)
def sitemap_top_up(spark, d):
    judged = sampling.judge_urls(v.sitemap(spark, d), GapSettings()).filter("reason IS NULL")
    usable = judged.filter("pos % 3 = 0")
    links = judged.filter("pos % 3 = 1")
    return (
        sampling.top_up(usable, links, GapSettings())
        .groupBy("site", "source")
        .agg(F.count("*").alias("pages"))
    )


@query(
    "child_sitemaps",
    """SELECT pos, url, CAST(CASE WHEN regexp_matches(url, 'page|product|service') THEN 0
        WHEN regexp_matches(url, 'post|blog|news|article') THEN 2 ELSE 1 END AS INTEGER) AS tier
    FROM (SELECT p_partkey AS pos, 'https://x.example.com/' || ['page', 'post', 'tag', 'author',
      'product', 'information', 'video', 'misc', 'news'][p_partkey % 9 + 1] || '-sitemap'
      || p_partkey || '.xml' AS url FROM part) WHERE pos % 9 NOT IN (2, 3, 6)""",
)
def child_sitemaps(spark, d):
    names = ["page", "post", "tag", "author", "product", "information", "video", "misc", "news"]
    name = F.element_at(
        F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 9 + 1).cast("int")
    )
    index = v.table(spark, d, "part").select(
        F.col("p_partkey").alias("pos"),
        F.concat(
            F.lit("https://x.example.com/"), name, F.lit("-sitemap"),
            F.col("p_partkey").cast("string"), F.lit(".xml"),
        ).alias("url"),
    )
    return sampling.child_sitemaps(index)


_TITLE = """replace(replace(replace(replace(
  regexp_extract(html, '<title>([^<]*)</title>', 1),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')"""


@query(
    "page_titles",
    f"""SELECT page_id, trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) AS title FROM pages""",
)
def page_titles(spark, d):
    return page_source.page_features(spread(_pages(spark, d)), T).select("page_id", "title")


_UNESCAPED = """regexp_replace(replace(replace(replace(replace(replace(replace(
  x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '&amp$', '&')"""
_PAGE_LINES = rf"""parts AS (SELECT page_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS part FROM (
    SELECT page_id, regexp_split_to_array(
      regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1), '</?(?:h1|p)>') AS p FROM pages)),
lines AS (SELECT page_id, line, min(i) AS i FROM (
    SELECT page_id, i, trim(regexp_replace({_UNESCAPED}, '\s+', ' ', 'g')) AS line FROM (
      SELECT page_id, i, regexp_replace(replace(part, '<br>', ' '), '<[^>]*>?', '', 'g') AS x FROM parts))
  WHERE line <> '' GROUP BY 1, 2),
texts AS (SELECT page_id, string_agg(line, chr(10) ORDER BY i) AS text FROM lines GROUP BY 1)"""


@query(
    "page_features",
    rf"""WITH {_PAGE_LINES}, t AS (SELECT p.page_id, html, coalesce(text, '') AS text FROM pages p LEFT JOIN texts USING (page_id)),
    w AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM t)
    SELECT page_id, trim(regexp_replace({_TITLE}, '\s+', ' ', 'g')) AS title, CAST(n AS INTEGER) AS words,
      CASE WHEN n >= {T.min_page_words} THEN 'ok' ELSE 'too_short' END AS status,
      CAST(contains(html, '<h1>') AS INTEGER) AS headings, '' AS schema_type,
      CAST(len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS INTEGER) AS links, text FROM w""",
)
def page_features(spark, d):
    return page_source.page_features(spread(_pages(spark, d)), T).select(
        "page_id", "title", "words", "status", F.size("headings").alias("headings"), "schema_type",
        F.size("links").alias("links"), "text",
    )


@query(
    "schema_types",
    """SELECT page_id, CASE page_id % 4 WHEN 3 THEN '' ELSE 'Type' || page_id % 5 END AS schema_type FROM pages""",
)
def schema_types(spark, d):
    """Pages with a JSON-LD block of page_id % 40 graphs inside each other, the telling type innermost."""
    n, deep = F.col("page_id"), (F.col("page_id") % 40).cast("int")
    kind = F.when(n % 4 == 3, "WebSite").otherwise(F.concat(F.lit("Type"), (n % 5).cast("string")))
    inner = F.when(
        n % 4 == 1, F.concat(F.lit('[{"@type":[]},{"@type":["'), kind, F.lit('"]}]'))
    ).otherwise(F.concat(F.lit('[7,{"@type":"'), kind, F.lit('","@graph":"none"}]')))
    block = F.concat(
        F.repeat(F.lit('{"@type":"WebPage","@graph":['), deep),
        F.when(deep == 0, inner).otherwise(F.substring(inner, F.lit(2), F.length(inner) - 2)),
        F.repeat(F.lit("]}"), deep),
    )
    broken = F.when(n % 3 == 0, '<script type="application/ld+json">{"@type":</script>').otherwise("")
    script = F.concat(broken, F.lit('<script type="application/ld+json">'), block, F.lit("</script>"))
    pages = _pages(spark, d).withColumn("html", F.concat(script, "html"))
    return page_source.page_features(spread(pages), T).select("page_id", "schema_type")


@query(
    "link_counts",
    """SELECT page_id, count(DISTINCT h) AS links FROM (
      SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages)
    GROUP BY 1""",
)
def link_counts(spark, d):
    links = page_source.link_table(page_source.page_features(spread(_pages(spark, d)), T))
    return links.groupBy("page_id").agg(F.count("*").alias("links"))


@query(
    "site_links",
    f"""WITH a AS (SELECT {domain('url')} AS site, {authority('url')} AS a, url,
      unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages)
    SELECT site, count(DISTINCT t) AS targets, count(DISTINCT t) FILTER (inside) AS internal FROM (
      SELECT site, starts_with(h, '/') AS inside,
        CASE WHEN starts_with(h, '/') THEN regexp_extract(url, '^[a-z]+://', 0) || a || h ELSE h END
        AS t FROM a) GROUP BY 1""",
)
def site_links(spark, d):
    return page_source.site_links(
        page_source.link_table(page_source.page_features(spread(_pages(spark, d)), T))
    )


@query(
    "title_check",
    f"""WITH t AS (SELECT page_id,
      trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) AS title FROM pages),
    w AS (SELECT *, CAST(ceil({width_sql('title')} * 20 / 1000.0) AS INTEGER) AS px FROM t)
    SELECT page_id, px AS title_px, CAST(length(title) AS INTEGER) AS title_chars,
      length(title) >= {T.title_chars} AND px <= {T.title_px} AS title_ok,
      array_to_string(list_filter([
        CASE WHEN px > {T.title_px} THEN
          'title is ' || px || 'px, over {T.title_px}px; Google will truncate it' END,
        CASE WHEN length(title) < {T.title_chars} THEN 'title is ' || length(title)
          || ' chars, under {T.title_chars}; room left unused' END,
        'description is 0 chars, under {T.description_min}'], lambda x: x IS NOT NULL), '; ')
        AS reasons FROM w""",
)
def title_check(spark, d):
    features = page_source.page_features(spread(_pages(spark, d)), T)
    checked = features.withColumn(
        "c", snippet_check(F.col("title"), F.col("description"), None, T)
    )
    return checked.select(
        "page_id", "c.title_px", "c.title_chars", "c.title_ok",
        F.array_join("c.reasons", "; ").alias("reasons"),
    )


def probe_tables(spark, d):
    """Site probes shaped from suppliers: domain s<k>, answers by the digits of k."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("s"), k.cast("string"), F.lit(".example.com"))
    base = v.table(spark, d, "supplier").select(k.alias("k"), name.alias("domain"))
    urls = base.select(
        "k", "domain", F.posexplode(u.variant_urls(F.col("domain"))).alias("variant_no", "url")
    )
    # k % 4: all go to https, http stays, www stays apart, nothing answers
    style = F.col("k") % 4
    home = F.concat(F.lit("https://"), "domain", F.lit("/"))
    final = (
        F.when((style == 1) & (F.col("variant_no") == 2), F.col("url"))
        .when((style == 2) & F.col("variant_no").isin(1, 3), F.col("url"))
        .otherwise(home)
    )
    probes = urls.select(
        "domain",
        "variant_no",
        "url",
        F.when(style == 3, F.lit(403)).otherwise(F.lit(200)).alias("status"),
        F.when(style == 3, F.col("url")).otherwise(final).alias("final_url"),
        F.lit("").alias("error"),
    )
    hops = urls.filter((style == 0) & (F.col("variant_no") > 0)).select(
        "domain",
        "variant_no",
        F.lit(1).alias("hop_no"),
        "url",
        F.when(F.col("k") % 8 == 0, F.lit(302)).otherwise(F.lit(301)).alias("status"),
    )
    codes = F.array(*[F.lit(c) for c in (200, 404, 403, 503, 200)])
    robots = base.select(
        "domain",
        F.element_at(codes, (F.col("k") % 5 + 1).cast("int")).alias("robots_status"),
        F.lit("").alias("robots_error"),
        F.lit(False).alias("robots_too_large"),
    )
    rules = base.filter("k % 5 = 4").select(
        F.col("domain").alias("host"),
        F.lit("*").alias("agent"),
        F.lit(False).alias("allow"),
        F.lit("/").alias("pattern"),
    )
    sitemaps = base.filter("k % 7 > 0").select(
        "domain",
        (F.col("k") % 3).cast("int").alias("sitemap_files"),
        (F.col("k") % 2 * 10).cast("int").alias("sitemap_urls"),
    )
    title = F.when(F.col("k") % 6 == 0, F.lit("")).otherwise(
        F.repeat(F.lit("Site title "), (F.col("k") % 6).cast("int"))
    )
    text = F.repeat(F.lit("Ten chars "), (F.col("k") % 20).cast("int"))
    homepages = base.select(
        "domain",
        F.lit(200).alias("page_status"),
        F.lit("").alias("page_error"),
        F.lit(False).alias("page_too_large"),
        F.lit(False).alias("blocks_us"),
        home.alias("final_url"),
        F.when(F.col("k") % 5 == 1, F.concat(F.lit("<"), home, F.lit('>; rel="canonical"')))
        .otherwise(F.lit(""))
        .alias("link_header"),
        F.when(F.col("k") % 11 == 0, F.array(F.lit("otherbot: noindex"), F.lit("googlebot: none")))
        .otherwise(F.array(F.lit("otherbot: noindex")))
        .alias("x_robots"),
        (F.col("k") % 13 > 0).alias("has_body"),
        F.trim(title).alias("title"),
        F.trim(text).alias("description"),
        F.when(F.col("k") % 9 == 0, F.array(F.lit("noindex, follow")))
        .otherwise(F.array(F.lit("index")))
        .alias("metas"),
        F.when(F.col("k") % 5 == 2, F.lit("https://other.example.org/"))
        .when(F.col("k") % 5 == 3, F.concat(home, F.lit("start")))
        .alias("canonical"),
    )
    return probes, hops, robots, rules, sitemaps, homepages


_CHECKS = f"""
WITH b AS (SELECT s_suppkey AS k, 's' || s_suppkey || '.example.com' AS domain,
  s_suppkey % 4 AS style FROM supplier),
t AS (SELECT *, trim(repeat('Site title ', CAST(k % 6 AS INTEGER))) AS title,
  trim(repeat('Ten chars ', CAST(k % 20 AS INTEGER))) AS txt FROM b),
w AS (SELECT *, CAST(ceil(coalesce({width_sql('title')}, 0) * 20 / 1000.0) AS INTEGER) AS px FROM t),
c AS (SELECT *, k % 13 > 0 AS read FROM w)
SELECT domain, 'https' AS key, CASE WHEN style = 3 THEN 'unknown' ELSE 'pass' END AS status FROM c
UNION ALL SELECT domain, 'http_redirect', CASE WHEN style IN (1, 3) THEN 'fail' ELSE 'pass' END FROM c
UNION ALL SELECT domain, 'one_address', CASE style WHEN 3 THEN 'unknown' WHEN 0 THEN 'pass'
  ELSE 'warn' END FROM c
UNION ALL SELECT domain, 'permanent_redirects', CASE WHEN k % 8 = 0 THEN 'warn' ELSE 'pass' END FROM c
UNION ALL SELECT domain, 'robots', CASE WHEN style = 3 THEN 'unknown' WHEN k % 5 = 3 THEN 'warn'
  WHEN k % 5 = 4 THEN 'fail' ELSE 'pass' END FROM c
UNION ALL SELECT domain, 'sitemap', CASE WHEN k % 7 = 0 THEN 'unknown'
  WHEN k % 3 > 0 AND k % 2 = 1 THEN 'pass' ELSE 'warn' END FROM c
UNION ALL SELECT domain, 'indexable', CASE WHEN NOT read THEN 'unknown'
  WHEN k % 11 = 0 OR k % 9 = 0 THEN 'fail' ELSE 'pass' END FROM c
UNION ALL SELECT domain, 'title', CASE WHEN NOT read THEN 'unknown' WHEN title = '' THEN 'fail'
  WHEN length(title) >= {T.title_chars} AND px <= {T.title_px} THEN 'pass' ELSE 'warn' END FROM c
UNION ALL SELECT domain, 'description', CASE WHEN NOT read THEN 'unknown'
  WHEN length(txt) BETWEEN {T.description_min} AND {T.description_max} THEN 'pass'
  ELSE 'warn' END FROM c
UNION ALL SELECT domain, 'canonical', CASE WHEN NOT read THEN 'unknown'
  WHEN k % 5 = 1 THEN 'pass' ELSE 'warn' END FROM c
"""


def _checked(spark, d) -> DataFrame:
    return checks.site_checks(checks.site_rows(*probe_tables(spark, d)), T)


@query("site_checks", _CHECKS)
def site_checks(spark, d):
    return _checked(spark, d).select("domain", "key", "status")


@query("site_check_details")
def site_check_details(spark, d):
    return _checked(spark, d)


@query(
    "check_counts",
    "SELECT domain, count(*) FILTER (status = 'pass') AS pass, "
    "count(*) FILTER (status = 'warn') AS warn, count(*) FILTER (status = 'fail') AS fail, "
    f"count(*) FILTER (status = 'unknown') AS unknown FROM ({_CHECKS}) GROUP BY 1",
)
def check_counts(spark, d):
    return checks.check_counts(_checked(spark, d))

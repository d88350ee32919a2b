"""Keyword discovery and its second pass over parts as page keywords, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom import fixed_values as fv
from rankloom.functions import text as tx
from rankloom.operators.ranks import competitor_ranks, with_positions
from rankloom.plans import discovery as disc
from rankloom.settings import GapSettings
from rankloom.workload import views as v
from rankloom.workload.gap_queries import measured
from rankloom.workload.registry import query
from rankloom.workload.text_queries import RAW_SQL, discovered
from rankloom.workload.views_sql import S, T, lit, sql, variant_key


def cleaned(text: str) -> str:
    """clean_phrase as SQL, for texts that are lower case and spaced already or plain."""
    p = f"""trim(regexp_replace(regexp_replace(lower({text}), '[^\\pL\\pN_\\s''&+.-]', ' ', 'g'), '\\s+', ' ', 'g'), ' .-''')"""
    bad = " OR ".join(f"contains(lower({text}), {lit(x)})" for x in ("http", "www.", "@", "<", ">"))
    return f"""(CASE WHEN NOT ({bad}) AND {p} <> '' AND len(string_split({p}, ' ')) <= {S.keyword_words}
      AND length({p}) <= {S.keyword_chars} AND NOT regexp_matches(replace({p}, ' ', ''), '^[0-9]+$')
      AND NOT regexp_matches({p}, {lit(fv.NAVIGATIONAL)}) THEN {p} END)"""


_HAS_DEMAND = f"(coalesce(searches, 0) >= {T.min_impressions} OR coalesce(autocomplete, FALSE))"
_BEST = "coalesce(searches, 0) DESC, coalesce(autocomplete, FALSE) DESC, n_pages DESC, o"
# no site's brand word ("example") occurs in a phrase, so brands mark nothing here; see brand_marks
_DISCOVERY = f"""
, {RAW_SQL},
spoken AS (SELECT r.run_id, d.domain, d.ord AS site_ord, r.url, r.source, {cleaned('r.phrase')} AS phrase,
    {{'s': 0, 'a': CAST(d.ord AS BIGINT), 'b': CAST(r.ord AS BIGINT), 'c': CAST(r.source <> 'page' AS BIGINT)}} AS o
  FROM raw r JOIN run_domains d ON d.run_id = r.run_id AND d.ord = r.ord % 5),
keyed AS (SELECT *, {variant_key('phrase')} AS variant_key FROM spoken WHERE phrase IS NOT NULL),
volumes_of AS (SELECT keyword, max(sold) % 40 AS searches FROM (
    SELECT {cleaned('phrase')} AS keyword, CAST(sum(l_quantity) AS INTEGER) AS sold
    FROM raw JOIN lineitem ON l_partkey = ord GROUP BY keyword, ord) WHERE keyword IS NOT NULL GROUP BY 1),
merged AS (SELECT run_id, variant_key, arg_min(phrase, o) AS keyword, min(o) AS o, list(DISTINCT domain) AS pages,
    count(DISTINCT domain) AS n_pages FROM keyed GROUP BY 1, 2),
checked AS (SELECT m.*, CAST(coalesce(v.searches, 0) AS INTEGER) AS searches,
    CASE WHEN v.keyword IS NOT NULL THEN length(m.keyword) % 2 = 0 END AS autocomplete
  FROM merged m LEFT JOIN volumes_of v USING (keyword)),
seeds AS (SELECT run_id, site, keyword, row_number() OVER (PARTITION BY run_id, site ORDER BY {_BEST}) AS n
  FROM (SELECT *, unnest(pages) AS site FROM checked WHERE {_HAS_DEMAND})),
told AS (SELECT s.run_id, {cleaned("s.keyword || ' supplies'")} AS phrase, v.searches + 20 AS volume,
    {{'s': 1, 'a': CAST(d.ord AS BIGINT), 'b': CAST(s.n AS BIGINT), 'c': CAST(1 AS BIGINT)}} AS o
  FROM seeds s JOIN volumes_of v USING (keyword) JOIN run_domains d ON d.run_id = s.run_id AND d.domain = s.site),
extra AS (SELECT run_id, variant_key, arg_min(phrase, o) AS keyword, min(o) AS o, CAST(arg_min(volume, o) AS INTEGER) AS volume
  FROM (SELECT *, {variant_key('phrase')} AS variant_key FROM told WHERE phrase IS NOT NULL) GROUP BY 1, 2),
fit_of AS (SELECT DISTINCT run_id, phrase AS keyword, CASE WHEN length(phrase) % 5 <> 4 THEN CAST(length(phrase) % 5 AS INTEGER) END AS fit
  FROM keyed),
both_ AS (SELECT coalesce(c.run_id, e.run_id) AS run_id, coalesce(c.variant_key, e.variant_key) AS variant_key,
    coalesce(c.keyword, e.keyword) AS keyword, coalesce(c.o, e.o) AS o, coalesce(c.pages, []) AS pages,
    coalesce(c.n_pages, 0) AS n_pages, coalesce(c.searches, e.volume) AS searches, c.autocomplete
  FROM checked c FULL JOIN extra e ON e.run_id = c.run_id AND e.variant_key = c.variant_key),
pool AS (SELECT b.*, {_HAS_DEMAND} AS wanted, CASE WHEN {_HAS_DEMAND} THEN f.fit END AS fit
  FROM both_ b LEFT JOIN fit_of f ON f.run_id = b.run_id AND f.keyword = b.keyword),
strong AS (SELECT * FROM pool WHERE wanted AND (fit IS NULL OR fit >= {S.min_fit})),
queues AS (SELECT run_id, q, list(variant_key ORDER BY place) AS keys FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, q ORDER BY tier, {_BEST}) AS place FROM (
      SELECT s.run_id, d.ord AS q, variant_key, 0 AS tier, searches, autocomplete, n_pages, o
      FROM (SELECT *, unnest(pages) AS site FROM strong) s JOIN run_domains d ON d.run_id = s.run_id AND d.domain = s.site
      UNION ALL SELECT run_id, -1, variant_key, 0, searches, autocomplete, n_pages, o FROM strong WHERE n_pages = 0
      UNION ALL SELECT run_id, -1, variant_key, 1, searches, autocomplete, n_pages, o FROM pool
        WHERE wanted AND fit >= {S.fill_min_fit} AND fit < {S.min_fit}))
  WHERE place <= {S.keywords} GROUP BY 1, 2),
turns AS (
  SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS step, CAST([] AS VARCHAR[]) AS chosen FROM queues
  UNION ALL
  SELECT t.run_id, step + 1, chosen || coalesce([list_filter(q.keys, lambda k: NOT list_contains(chosen, k))[1]], [])
  FROM turns t LEFT JOIN queues q ON q.run_id = t.run_id AND q.q = step % 5
  WHERE step < 5 * {S.keywords} AND len(list_filter(chosen, lambda k: k IS NOT NULL)) < {S.keywords}),
dealt AS (SELECT run_id, list_filter(arg_max(chosen, step), lambda k: k IS NOT NULL) AS chosen FROM turns GROUP BY 1),
filled AS (SELECT d.run_id, (chosen || list_filter(coalesce(x.keys, []), lambda k: NOT list_contains(chosen, k)))[:{S.keywords}] AS keys
  FROM dealt d LEFT JOIN queues x ON x.run_id = d.run_id AND x.q = -1),
picks AS (SELECT run_id, unnest(keys) AS variant_key, unnest(range(1, len(keys) + 1)) AS picked FROM filled)
"""


def _discovery_sql(body: str, *views: str) -> str:
    return sql("run_domains", *views, body=_DISCOVERY + body).replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "discovery_picked",
    _discovery_sql("""SELECT p.run_id, CAST(picked AS INTEGER) AS picked, keyword, searches, autocomplete, fit
    FROM picks p JOIN pool USING (run_id, variant_key)"""),
)
def discovery_picked(spark, d):
    return discovered(spark, d).picked.select(
        "run_id", "picked", "keyword", "searches", "autocomplete", "fit"
    )


@query(
    "discovery_counts",
    _discovery_sql(f"""SELECT p.run_id, p.candidates, CAST(0 AS BIGINT) AS branded, p.no_fit,
      c.no_demand, p.candidates - c.checks AS not_checked
    FROM (SELECT run_id, count(*) AS candidates, count(*) FILTER (fit = 0) AS no_fit FROM pool GROUP BY 1) p
    JOIN (SELECT run_id, count(*) AS checks, count(*) FILTER (autocomplete IS NOT NULL AND NOT {_HAS_DEMAND}) AS no_demand
      FROM checked GROUP BY 1) c USING (run_id)"""),
)
def discovery_counts(spark, d):
    return discovered(spark, d).counts


@query(
    "second_pass",
    _discovery_sql(
        f""", proven AS (SELECT DISTINCT p.run_id, p.keyword, k.ord FROM positions p
      JOIN keywords k ON k.run_id = p.run_id AND k.keyword = p.keyword WHERE p.ord > 0 AND p.position IS NOT NULL),
    asked AS (SELECT run_id, phrase, {variant_key('phrase')} AS variant_key, o FROM (
      SELECT run_id, {cleaned("CASE pos WHEN 0 THEN keyword || ' parts' ELSE 'buy ' || keyword END")} AS phrase,
        {{'k': ord, 'p': pos}} AS o FROM proven, (VALUES (0), (1)) t(pos)) WHERE phrase IS NOT NULL),
    fresh AS (SELECT run_id, variant_key, arg_min(phrase, o) AS keyword, min(o) AS o FROM asked a
      WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.run_id = a.run_id AND p.variant_key = a.variant_key) GROUP BY 1, 2)
    SELECT run_id, CAST(picked AS INTEGER) AS picked, keyword, searches FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY searches DESC, o) AS picked FROM (
        SELECT *, CAST(length(keyword) * 7 % 30 AS INTEGER) AS searches FROM fresh) WHERE searches >= {T.min_impressions})
    WHERE picked <= {S.second_pass}""",
        "positions", "keywords",
    ),
)
def second_pass(spark, d):
    s = GapSettings()
    kw = measured(spark, d)
    placed = with_positions(kw, v.shared_serp(spark, d), v.run_domains(spark, d), s)
    rankings = placed.select(
        "run_id", "keyword", "ord", competitor_ranks(F.col("sites")).alias("proven")
    )
    related = kw.select(
        "run_id",
        "keyword",
        F.posexplode(
            F.array(F.concat("keyword", F.lit(" parts")), F.concat(F.lit("buy "), "keyword"))
        ).alias("pos", "query"),
    )
    fresh = related.select(tx.clean_phrase(F.col("query")).alias("keyword")).distinct()
    volumes = fresh.select("keyword", (F.length("keyword") * 7 % 30).alias("searches"))
    found = discovered(spark, d)
    picked = disc.second_pass(related, rankings, found, volumes, None, None, s)
    return picked.select("run_id", "picked", "keyword", "searches")

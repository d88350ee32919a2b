"""Rank check, keyword metrics, gap and snapshot queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import fixed_values as fv
from rankloom.functions import labels
from rankloom.operators import candidates, clusters, demand, gap, notes, ranks, snapshot
from rankloom.operators.listing import write_listing
from rankloom.operators.passes import merge_passes, refresh
from rankloom.plans import keyword_gap as kg
from rankloom.plans.snapshot import site_snapshot
from rankloom.session import cut_lineage
from rankloom.settings import GapSettings, SnapshotSettings
from rankloom.sources import sinks
from rankloom.workload import views as v
from rankloom.workload.registry import query
from rankloom.workload.views_sql import (
    S,
    T,
    greedy_heads,
    in_list,
    lit,
    owned_by_any,
    rounded,
    sql,
    url_key,
)


def measured(spark: SparkSession, d: str) -> DataFrame:
    """Keywords with their monthly demand."""
    volumes = demand.monthly_demand(v.impressions(spark, d), ["ord"], v.TODAY)
    return v.keywords(spark, d).join(volumes, "ord", "left").withColumn(
        "searches", F.coalesce("searches", F.lit(0))
    )


def inputs(spark: SparkSession, d: str):
    return (
        measured(spark, d),
        v.shared_serp(spark, d),
        v.run_domains(spark, d),
        v.site_ranks(spark, d),
    )


def gap_result(spark: SparkSession, d: str, cluster: bool = False) -> kg.GapResult:
    return kg.keyword_gap(*inputs(spark, d), GapSettings(), cluster=cluster)


def snap(spark: SparkSession, d: str):
    return site_snapshot(*inputs(spark, d), SnapshotSettings())


_REASON = """g.ranked || ' of ' || g.rivals || ' competitors rank: ' || r.listed
  || CASE WHEN category = 'weak' THEN '; you rank #' || g.ours ELSE '' END
  || CASE WHEN g.traffic_lift > 0 THEN '; about ' || g.traffic_lift
     || ' more visits a month at #' || g.best ELSE '' END"""

_TOP = f"""
, rivals AS (SELECT run_id, keyword,
    string_agg(domain || ' #' || position, ', ' ORDER BY position, ord) AS listed,
    arg_min(domain, {{'p': position, 'o': ord}}) AS best_competitor,
    arg_min(url, {{'p': position, 'o': ord}}) AS best_url
  FROM positions WHERE ord > 0 AND position IS NOT NULL GROUP BY 1, 2),
picked AS (SELECT *, CASE WHEN list_contains(categories, 'missing') THEN 'missing'
      WHEN list_contains(categories, 'weak') THEN 'weak'
      WHEN list_contains(categories, 'untapped') THEN 'untapped' END AS category FROM gap)
SELECT run_id, CAST(place AS INTEGER) AS place, keyword, category, reason, business_fit, proof,
  difficulty, difficulty_band, traffic_lift, best_competitor, best AS best_position, best_url
FROM (SELECT g.*, r.best_competitor, r.best_url, {_REASON} AS reason,
    row_number() OVER (PARTITION BY g.run_id ORDER BY coalesce(business_fit, {S.min_fit}) DESC,
      proof DESC, coalesce(difficulty, 101), coalesce(searches, 0) DESC, g.keyword) AS place
  FROM picked g JOIN rivals r USING (run_id, keyword)
  WHERE category IS NOT NULL AND coalesce(business_fit, {S.min_fit}) >= {S.min_fit})
WHERE place <= {S.top_keywords}"""


@query("gap_top_keywords", sql("gap", body=_TOP))
def gap_top_keywords(spark, d):
    return gap_result(spark, d).top


@query("rank_check", sql("positions", body="SELECT * FROM positions"))
def rank_check(spark, d):
    return ranks.rank_check(
        v.keywords(spark, d), v.shared_serp(spark, d), v.run_domains(spark, d), GapSettings()
    )


@query(
    "gap_categories",
    sql(
        "gap",
        body="""SELECT run_id, keyword, array_to_string(categories, ';') AS categories, proof,
        traffic_lift, estimate, searches, searches_status FROM gap""",
    ),
)
def gap_categories(spark, d):
    return gap_result(spark, d).rows.select(
        "run_id",
        "keyword",
        F.array_join("categories", ";").alias("categories"),
        "proof",
        "traffic_lift",
        "estimate",
        "searches",
        "searches_status",
    )


@query(
    "keyword_metrics",
    sql(
        "metrics",
        body="""SELECT run_id, keyword, searches, searches_status, estimate, difficulty,
        difficulty_band, intent FROM metrics""",
    ),
)
def keyword_metrics(spark, d):
    return kg.metric_rows(*inputs(spark, d), GapSettings()).select(
        "run_id", "keyword", "searches", "searches_status", "estimate", "difficulty",
        "difficulty_band", "intent",
    )


@query(
    "site_visits",
    sql("sites", body="SELECT run_id, keyword, ord, domain, position, url, visits FROM sites"),
)
def site_visits(spark, d):
    return gap.site_rows(kg.metric_rows(*inputs(spark, d), GapSettings()))


@query(
    "category_counts",
    sql(
        "gap",
        body=f"""SELECT r.run_id, c.category,
          count(g.keyword) FILTER (list_contains(g.categories, c.category)) AS keywords
        FROM (SELECT DISTINCT run_id FROM gap) r
        CROSS JOIN (SELECT unnest([{', '.join(lit(c) for c in fv.CATEGORIES)}]) AS category) c
        LEFT JOIN gap g USING (run_id) GROUP BY 1, 2""",
    ),
)
def category_counts(spark, d):
    return gap_result(spark, d).counts


@query(
    "competitor_panels",
    sql(
        "sites",
        body="""SELECT run_id, ord, domain, count(position) AS keywords_ranked,
        CAST(coalesce(sum(visits) FILTER (position IS NOT NULL), 0) AS BIGINT) AS visits_known
        FROM sites WHERE ord > 0 GROUP BY 1, 2, 3""",
    ),
)
def competitor_panels(spark, d):
    return gap_result(spark, d).panels


@query(
    "competitor_top_keywords",
    sql(
        "sites",
        body=f"""SELECT run_id, ord, domain, CAST(place AS INTEGER) AS place, keyword, position, url,
        visits FROM (SELECT *, row_number() OVER (PARTITION BY run_id, ord
          ORDER BY coalesce(visits, 0) DESC, position, keyword) AS place
          FROM sites WHERE ord > 0 AND position IS NOT NULL) WHERE place <= {S.top_keywords}""",
    ),
)
def competitor_top_keywords(spark, d):
    return gap_result(spark, d).panel_top


@query(
    "suggested_competitors",
    sql(
        "keywords", "serp", "run_domains",
        body=f"""
, hits AS (SELECT s.run_id, s.keyword, s.domain, arg_min(s.rank, s.pos) AS rank
  FROM serp s JOIN keywords w USING (run_id, keyword)
  WHERE s.pos <= 10 AND s.page_type NOT IN {in_list(fv.UGC_TYPES)}
    AND coalesce(w.business_fit, {S.min_fit}) >= {S.min_fit}
    AND NOT {owned_by_any('s.domain', fv.PLATFORM_DOMAINS)}
    AND NOT EXISTS (SELECT 1 FROM run_domains x WHERE x.run_id = s.run_id
      AND (s.domain = x.domain OR ends_with(s.domain, '.' || x.domain)))
  GROUP BY 1, 2, 3),
scored AS (SELECT run_id, domain, count(*) AS keywords, min(rank) AS best_position,
    array_to_string(list(keyword ORDER BY rank, keyword)[1:3], ';') AS examples
  FROM hits GROUP BY 1, 2 HAVING count(*) >= {S.suggested_min_keywords})
SELECT * FROM (SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id
    ORDER BY keywords DESC, best_position, domain) AS INTEGER) AS place,
  domain, keywords, best_position, examples FROM scored) WHERE place <= {S.suggested_sites}""",
    ),
)
def suggested_competitors(spark, d):
    return gap_result(spark, d).suggested.withColumn("examples", F.array_join("examples", ";"))


@query(
    "site_tiles",
    sql(
        "sites",
        body="""SELECT run_id, ord, domain, count(position) AS found,
        count(*) FILTER (position <= 10) AS page_one,
        CAST(coalesce(sum(visits), 0) AS BIGINT) AS visits, count(*) AS keywords
        FROM sites GROUP BY 1, 2, 3""",
    ),
)
def site_tiles(spark, d):
    return gap_result(spark, d).tiles


def _cell(expr: str) -> str:
    return f"coalesce(CAST({expr} AS VARCHAR), '')"


def _safe(expr: str) -> str:
    return (
        f"(CASE WHEN regexp_matches({expr}, '^[=+\\-@\\t\\r]') THEN '''' || {expr} ELSE {expr} END)"
    )


_SITE_CELLS = ",\n".join(
    f"max(CASE WHEN ord = {i} THEN position END) AS position_{i}, "
    f"max(CASE WHEN ord = {i} THEN visits END) AS visits_{i}, "
    f"max(CASE WHEN ord = {i} THEN url END) AS url_{i}"
    for i in range(5)
)


@query(
    "keyword_csv_pivot",
    sql(
        "gap", "sites",
        body=f"""
, wide AS (SELECT run_id, keyword, {_SITE_CELLS} FROM sites GROUP BY 1, 2)
SELECT g.run_id, {_safe('g.keyword')} AS keyword, array_to_string(categories, ';') AS categories,
  {_cell('business_fit')} AS business_fit,
  {', '.join(f"{_cell(f'position_{i}')} AS position_{i}" for i in range(5))},
  {_cell('searches')} AS bing_searches_per_month, searches_status AS bing_status,
  {_cell('estimate')} AS google_searches_estimate,
  {', '.join(f"{_cell(f'visits_{i}')} AS visits_estimate_{i}" for i in range(5))},
  {_cell('traffic_lift')} AS traffic_lift, {_cell('difficulty')} AS difficulty,
  {_cell('difficulty_band')} AS difficulty_band, intent, {_safe('g.keyword')} AS cluster,
  '' AS serp_features, {', '.join(f"url_{i} AS ranking_url_{i}" for i in range(5))}, '' AS sources
FROM gap g JOIN wide USING (run_id, keyword)""",
    ),
)
def keyword_csv_pivot(spark, d):
    return sinks.safe_cells(sinks.keyword_table(gap_result(spark, d).rows, 5))


_FILTERED = gap.GapFilter(
    tab="untapped", exclude=("anvil",), band="medium", min_competitors=2, measured_only=True
)


@query(
    "gap_table_page",
    sql(
        "gap",
        body="""SELECT run_id, keyword, proof, traffic_lift, difficulty FROM gap
        WHERE list_contains(categories, 'untapped') AND NOT contains(lower(keyword), 'anvil')
          AND difficulty_band = 'medium' AND ranked >= 2 AND searches_status = 'measured'
        ORDER BY traffic_lift DESC NULLS LAST, keyword, run_id LIMIT 25 OFFSET 25""",
    ),
)
def gap_table_page(spark, d):
    rows = gap.filter_rows(gap_result(spark, d).rows, _FILTERED)
    table = write_listing(rows, gap.table_order("lift", True))
    return table.page(1).select("run_id", "keyword", "proof", "traffic_lift", "difficulty")


@query(
    "listing_page",
    sql(
        "listing",
        body="""SELECT run_id, keyword, position, coalesce(searches, 0) AS searches,
          CAST(row_number() OVER (ORDER BY run_id, position NULLS LAST, coalesce(searches, 0) DESC, keyword) AS BIGINT) AS place
        FROM listing QUALIFY place > 75 AND place <= 100""",
    ),
)
def listing_page(spark, d):
    """The page after the 75th row of our sites' keywords, in their listing order."""
    rows = snap(spark, d).keywords
    table = write_listing(rows, [F.col("run_id").asc(), *snapshot.listing_order()])
    return table.after(75).select(
        "run_id", "keyword", "position", F.coalesce("searches", F.lit(0)).alias("searches"), "place"
    )


def _second_pass_runs() -> Column:
    return F.regexp_extract("run_id", r"(\d)$", 1).cast("int") % 2 == 0


@query(
    "merged_passes",
    sql(
        "gap",
        body="""SELECT run_id, keyword, CASE WHEN kw_ord % 3 < 2 THEN 1 ELSE 2 END AS pass, proof,
          array_to_string(categories, ';') AS categories FROM gap
        WHERE kw_ord % 3 < 2 OR CAST(right(run_id, 1) AS INTEGER) % 2 = 0""",
    ),
)
def merged_passes(spark, d):
    """Keywords of two passes, the first one's rows before the second's, and the gap of the runs that the
    second pass adds to computed again."""
    kw, serp, sites, strengths = inputs(spark, d)
    first = kw.filter("ord % 3 < 2")
    second = kw.filter("ord % 3 >= 1").filter(_second_pass_runs())
    merged = cut_lineage(merge_passes([first, second], ["run_id", "keyword"]))

    def rows(*parts: DataFrame) -> DataFrame:
        return kg.keyword_gap(*parts, GapSettings()).rows.select("run_id", "keyword", "proof", "categories")

    before = rows(first, serp, sites, strengths)
    added = merged.filter(F.col("pass") > 1)
    after = refresh(before, [merged.drop("pass"), serp, sites, strengths], added, rows)
    return after.join(merged.select("run_id", "keyword", "pass"), ["run_id", "keyword"]).select(
        "run_id", "keyword", "pass", "proof", F.array_join("categories", ";").alias("categories")
    )


def _typed_sites(spark, d) -> DataFrame:
    """Sites a user might type together: suppliers of one nation, hosts as shown in results."""
    k = F.col("s_suppkey")
    order = F.floor(k / 25).cast("int")
    return (
        v.table(spark, d, "supplier")
        .select(
            F.col("s_nationkey").cast("string").alias("run_id"),
            order.alias("ord"),
            F.concat(
                F.when(k % 3 == 1, "blog.").otherwise(""),
                F.lit("s"),
                F.floor(k % 10 / 2).cast("string"),
                F.lit(".example.com"),
            ).alias("domain"),
        )
    )


@query(
    "domain_set_errors",
    f"""WITH d AS (SELECT CAST(s_nationkey AS VARCHAR) AS run_id,
      CAST(s_suppkey // 25 AS INTEGER) AS ord,
      CASE WHEN s_suppkey % 3 = 1 THEN 'blog.' ELSE '' END || 's' || ((s_suppkey % 10) // 2)
        || '.example.com' AS domain FROM supplier),
    sets AS (SELECT run_id, count(*) FILTER (ord > 0) AS rivals,
      count(DISTINCT domain) FILTER (ord > 0) AS uniq,
      max(domain) FILTER (ord = 0) AS ours FROM d GROUP BY 1)
    SELECT run_id, 'no competitor' AS problem, '' AS detail FROM sets WHERE rivals = 0
    UNION ALL SELECT run_id, 'too many competitors', CAST(rivals AS VARCHAR) FROM sets
      WHERE rivals > {S.max_competitors}
    UNION ALL SELECT run_id, 'competitor listed twice', '' FROM sets WHERE uniq < rivals
    UNION ALL SELECT DISTINCT run_id, 'own site listed', domain FROM d JOIN sets USING (run_id)
      WHERE ord > 0 AND domain = ours
    UNION ALL SELECT DISTINCT a.run_id, 'nested domains', a.domain || ' in ' || b.domain
      FROM d a JOIN d b ON a.run_id = b.run_id AND ends_with(a.domain, '.' || b.domain)""",
)
def domain_set_errors(spark, d):
    return gap.domain_set_errors(_typed_sites(spark, d), GapSettings())


@query(
    "run_notes",
    sql(
        "gap", "serp",
        body=f"""
, c AS (SELECT g.run_id, count(*) AS n, count(*) FILTER (searches_status = 'measured') AS measured,
    count(*) FILTER (difficulty IS NULL) AS few,
    count(*) FILTER (ours IS NULL AND ranked = 0) AS unranked,
    count(*) FILTER (s.seen IS NULL) AS empty
  FROM gap g LEFT JOIN (SELECT run_id, keyword, count(*) AS seen FROM serp GROUP BY 1, 2) s
    USING (run_id, keyword) GROUP BY 1)
SELECT run_id, empty || ' keyword(s) returned no Google results' AS note FROM c WHERE empty > 0
UNION ALL SELECT run_id, 'visits shown for ' || measured || ' of ' || n
  || ' keywords; Bing has no numbers for the others' FROM c WHERE measured < n
UNION ALL SELECT run_id, few || ' keyword(s) had fewer than {S.min_results} results: no difficulty'
  FROM c WHERE few > 0
UNION ALL SELECT run_id, unranked
  || ' checked keyword(s): none of the sites is on the first 2 pages' FROM c WHERE unranked > 0""",
    ),
)
def run_notes(spark, d):
    kw, serp, sites, strengths = inputs(spark, d)
    rows = kg.keyword_gap(kw, serp, sites, strengths, GapSettings()).rows
    return notes.run_notes(rows, notes.missing_searches(kw, serp), GapSettings())


@query("difficulty", sql("profile", body="SELECT * FROM profile"))
def difficulty(spark, d):
    return ranks.serp_profile(v.shared_serp(spark, d), v.site_ranks(spark, d), T).select(
        "run_id", "keyword", "results", "difficulty", "small_sites"
    )


@query("serp_intent", sql("intents", body="SELECT * FROM intents"))
def serp_intent(spark, d):
    return (
        ranks.serp_profile(v.shared_serp(spark, d), v.site_ranks(spark, d), T)
        .select("run_id", "keyword", "intent")
        .filter("intent <> 'unknown'")
    )


def _our_type():
    kinds = F.array(*[F.lit(x) for x in ("product", "guide", "listicle", "tool")])
    return F.element_at(kinds, (F.col("ord") % 4 + 1).cast("int"))


@query(
    "intent_verdict",
    sql(
        "keywords", "top",
        body=f"""
, kinds AS (SELECT run_id, keyword, page_type, count(*) AS n, min(pos) AS p FROM top
    WHERE page_type NOT IN {in_list(fv.NO_INTENT_TYPES)} GROUP BY 1, 2, 3),
one AS (SELECT k.run_id, k.keyword, sum(n) AS known,
    string_agg(page_type || '=' || n, ';' ORDER BY n DESC, p) AS mix,
    arg_min(page_type, {{'n': -n, 'p': p}}) AS dominant, max(n) AS lead,
    coalesce(max(n) FILTER (page_type = w.ours), 0) AS ours_n, max(w.ours) AS ours
  FROM kinds k JOIN (SELECT run_id, keyword,
      ['product', 'guide', 'listicle', 'tool'][ord % 4 + 1] AS ours FROM keywords) w
    USING (run_id, keyword) GROUP BY 1, 2)
SELECT run_id, keyword, mix, dominant, round_even(lead / known, 2) AS dominant_share, verdict,
  CASE WHEN ours_n = 0 THEN 'Strong mismatch: no ' || ours
      || ' pages rank in the top 10; Google shows mostly ' || dominant || ' pages ('
      || {rounded('lead / known * 100')} || '%).'
    WHEN verdict = 'clear' AND ours <> dominant THEN 'Intent mismatch: '
      || {rounded('lead / known * 100')} || '% of the top 10 are ' || dominant
      || ' pages; ours is a ' || ours || ' page (' || ours_n || ' of ' || known || ' results).'
  END AS flag
FROM (SELECT *, CASE WHEN lead / known >= {T.clear_share} THEN 'clear'
    WHEN lead / known <= {T.mixed_share} THEN 'mixed' ELSE 'leaning' END AS verdict FROM one)""",
    ),
)
def intent_verdict(spark, d):
    profile = ranks.serp_profile(v.shared_serp(spark, d), v.site_ranks(spark, d), T)
    types = F.transform("top", lambda x: x["page_type"])
    judged = profile.join(v.keywords(spark, d), ["run_id", "keyword"]).withColumn(
        "iv", ranks.intent_verdict(types, _our_type(), T)
    )
    mix = F.transform(
        "iv.mix", lambda m: F.concat(m["type"], F.lit("="), m["n"].cast("string"))
    )
    return judged.filter(F.size("iv.mix") > 0).select(
        "run_id",
        "keyword",
        F.array_join(mix, ";").alias("mix"),
        "iv.dominant",
        "iv.dominant_share",
        "iv.verdict",
        "iv.flag",
    )


WEAK_FLAGS = f"""flags AS (SELECT t.run_id, t.keyword, count(*) FILTER (page_type = 'forum') AS forums,
    arg_min(t.domain, t.pos) FILTER (page_type = 'forum') AS forum,
    count(*) FILTER (CAST(t.title[8:] AS INTEGER) <= {v.YEAR - T.stale_years}) AS stale,
    max(p.small_sites) AS small
  FROM top t JOIN profile p USING (run_id, keyword) GROUP BY 1, 2),
spots AS (SELECT run_id, keyword, list_filter([
    CASE WHEN forums > 0 THEN 'forum in top 10 (' || forum || ')' END,
    CASE WHEN stale > 0 THEN stale || ' stale page(s) in top 10' END,
    CASE WHEN small >= {T.small_sites_min} THEN small || ' small site(s) in top 10' END],
    lambda x: x IS NOT NULL) AS signals,
  (CASE WHEN forums > 0 THEN {T.forum_bonus}e0 ELSE 0e0 END)
    + least({T.stale_counted}, stale) * {T.stale_bonus}e0
    + (CASE WHEN small >= {T.small_sites_min} THEN {T.small_sites_bonus}e0 ELSE 0e0 END) AS bonus FROM flags)"""


@query(
    "weak_spots",
    sql(
        "top", "profile",
        body=f""", {WEAK_FLAGS}
SELECT run_id, keyword, array_to_string(signals, '; ') AS signals, round_even(bonus, 4) AS bonus FROM spots""",
    ),
)
def weak_spots(spark, d):
    profile = ranks.serp_profile(v.shared_serp(spark, d), v.site_ranks(spark, d), T)
    return profile.withColumn(
        "w", ranks.weak_spots(F.col("top"), F.col("small_sites"), v.YEAR, T)
    ).select(
        "run_id",
        "keyword",
        F.array_join("w.signals", "; ").alias("signals"),
        F.bround("w.bonus", 4).alias("bonus"),
    )


@query(
    "site_strength",
    sql(
        "serp", "site_ranks",
        body="""SELECT s.domain, coalesce(a.rank, b.rank) AS site_rank, s.results FROM
        (SELECT domain, count(*) AS results FROM serp GROUP BY 1) s
        LEFT JOIN site_ranks a ON a.domain = s.domain
        LEFT JOIN site_ranks b ON b.domain = regexp_replace(s.domain, '^[^.]*\\.', '')""",
    ),
)
def site_strength(spark, d):
    results = v.serp(spark, d).groupBy("domain").agg(F.count("*").alias("results"))
    return ranks.domain_ranks(results, v.site_ranks(spark, d)).select(
        "domain", "site_rank", "results"
    )


@query(
    "exact_site_rank",
    sql(
        "serp", "site_ranks",
        body="""SELECT s.domain, a.rank FROM (SELECT DISTINCT domain FROM serp) s
        LEFT JOIN site_ranks a USING (domain)""",
    ),
)
def exact_site_rank(spark, d):
    return ranks.exact_lookup(
        v.serp(spark, d).select("domain").distinct(), v.site_ranks(spark, d)
    )


@query("monthly_demand", sql("volumes", body="SELECT * FROM volumes"))
def monthly_demand(spark, d):
    return demand.monthly_demand(v.impressions(spark, d), ["ord"], v.TODAY)


def _related(spark, d) -> DataFrame:
    """Suppliers' parts as related keywords of a seed (the supplier)."""
    return (
        v.table(spark, d, "lineitem")
        .groupBy("l_suppkey", "l_partkey")
        .agg(F.sum("l_quantity").cast("int").alias("impressions"))
        .select(
            F.concat(F.lit("seed "), F.col("l_suppkey").cast("string")).alias("phrase"),
            F.concat(F.lit(" Part  "), F.col("l_partkey").cast("string")).alias("suggestion"),
            "impressions",
            F.col("l_partkey").alias("pos"),
        )
    )


@query(
    "related_demand",
    f"""SELECT phrase, pos, keyword, volume, CAST(place AS INTEGER) AS place FROM (
      SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY volume DESC, pos) AS place FROM (
        SELECT 'seed ' || l_suppkey AS phrase, l_partkey AS pos, 'part ' || l_partkey AS keyword,
          {rounded('CAST(sum(l_quantity) AS INTEGER) / 3e0')} AS volume
        FROM lineitem GROUP BY l_suppkey, l_partkey)) WHERE place <= 50""",
)
def related_demand(spark, d):
    return demand.related_demand(_related(spark, d), 50)


def _suggestion_lists(spark, d) -> DataFrame:
    """Every third keyword autocompletes to itself, every third to something longer or other."""
    kw = F.col("keyword")
    lists = (
        F.when(F.col("ord") % 3 == 0, F.array(kw))
        .when(F.col("ord") % 3 == 1, F.array(F.concat(kw, F.lit(" price")), F.lit("x")))
        .otherwise(F.array(F.concat(kw, F.lit("s"))))
    )
    return v.keywords(spark, d).select("keyword", lists.alias("list"))


@query(
    "demand_gate",
    sql(
        "demand",
        body=f"""SELECT run_id, keyword, searches AS volume, ord % 3 < 2 AS in_autocomplete,
          searches >= {T.min_impressions} OR ord % 3 < 2 AS kept,
          CASE WHEN searches >= {T.min_impressions} OR ord % 3 < 2 THEN ''
            ELSE 'no demand: ' || searches || ' Bing impressions < {T.min_impressions}, '
              || 'not in Google autocomplete' END AS reason
        FROM demand""",
    ),
)
def demand_gate(spark, d):
    volumes = measured(spark, d).select("keyword", "searches")
    rows = demand.attach_demand(v.keywords(spark, d), volumes, _suggestion_lists(spark, d))
    named = rows.select(
        "run_id",
        "keyword",
        F.col("searches").alias("volume"),
        F.col("autocomplete").alias("in_autocomplete"),
    )
    return demand.demand_gate(named, T)


@query(
    "difficulty_ceiling",
    sql(
        "metrics",
        body="""SELECT run_id, keyword, difficulty, coalesce(difficulty <= 30, FALSE) AS kept,
          CASE WHEN difficulty IS NULL THEN 'no difficulty score'
               WHEN difficulty > 30 THEN 'difficulty ' || difficulty || ' > 30 (new site)'
               ELSE '' END AS reason FROM metrics""",
    ),
)
def difficulty_ceiling(spark, d):
    rows = kg.metric_rows(*inputs(spark, d), GapSettings())
    return demand.difficulty_ceiling(
        rows.select("run_id", "keyword", "difficulty"), GapSettings()
    )


@query(
    "pre_rank",
    sql(
        "metrics",
        body=f"""SELECT run_id, keyword, CAST(place AS INTEGER) AS place FROM (
          SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY
            round_even(coalesce(business_fit, 0) * log10(2e0 + coalesce(searches, 0))
              * (1e0 - coalesce(difficulty, 0) / 100e0), 6) DESC, keyword) AS place
          FROM metrics) WHERE place <= {T.pre_rank_keep}""",
    ),
)
def pre_rank(spark, d):
    rows = kg.metric_rows(*inputs(spark, d), GapSettings())
    score = candidates.pre_score(
        F.coalesce("business_fit", F.lit(0)),
        F.coalesce("searches", F.lit(0)),
        F.col("difficulty"),
    )
    best = candidates.best_by_score(rows, F.bround(score, 6), T.pre_rank_keep)
    return best.select("run_id", "keyword", "place")


@query(
    "serp_overlap",
    sql(
        "serp",
        body=f"""
, m AS (SELECT DISTINCT run_id, keyword, {url_key('url')} AS u FROM serp WHERE pos <= 10),
pairs AS (SELECT a.run_id, a.keyword AS x, b.keyword AS y FROM m a JOIN m b
  ON a.run_id = b.run_id AND a.u = b.u AND a.keyword <> b.keyword
  GROUP BY 1, 2, 3 HAVING count(*) >= {T.min_shared_urls})
SELECT k.run_id, count(p.x) AS overlapping, count(*) AS items
FROM (SELECT DISTINCT run_id, keyword FROM m) k
LEFT JOIN (SELECT DISTINCT run_id, x FROM pairs) p ON p.run_id = k.run_id AND p.x = k.keyword
GROUP BY 1""",
    ),
)
def serp_overlap(spark, d):
    members = clusters.serp_members(v.serp(spark, d), T.serp_top)
    return clusters.overlap_degree(members, T.min_shared_urls)


@query(
    "url_popularity",
    sql(
        "serp",
        body=f"""SELECT run_id, {url_key('url')} AS element, count(DISTINCT keyword) AS keywords
        FROM serp WHERE pos <= 10 GROUP BY 1, 2""",
    ),
)
def url_popularity(spark, d):
    return clusters.url_popularity(clusters.serp_members(v.serp(spark, d), T.serp_top))


CLOSE_KEYWORDS = f"""SELECT x.run_id, i.n AS a, j.n AS b FROM (
    SELECT p.run_id, p.keyword AS x, q.keyword AS y FROM m p JOIN m q
      ON p.run_id = q.run_id AND p.u = q.u AND p.keyword <> q.keyword
    GROUP BY 1, 2, 3 HAVING count(*) >= {T.min_shared_urls}) x
  JOIN placed i ON i.run_id = x.run_id AND i.item = x.x
  JOIN placed j ON j.run_id = x.run_id AND j.item = x.y WHERE j.n < i.n"""


@query(
    "keyword_clusters",
    sql(
        "gap", "serp", "keywords",
        body=f"""
, m AS (SELECT DISTINCT run_id, keyword, {url_key('url')} AS u FROM serp WHERE pos <= {T.serp_top}),
placed AS (SELECT run_id, keyword AS item, row_number() OVER (PARTITION BY run_id
  ORDER BY coalesce(gap.business_fit, 0) DESC, coalesce(gap.searches, 0) DESC, k.ord, keyword) AS n
  FROM gap JOIN (SELECT run_id, keyword, ord FROM keywords) k USING (run_id, keyword)),
{greedy_heads('SELECT run_id, item, n FROM placed', CLOSE_KEYWORDS)}
SELECT run_id, item AS keyword, head AS cluster FROM headed""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def keyword_clusters(spark, d):
    kw, serp, _, _ = inputs(spark, d)
    return clusters.serp_clusters(kw, serp, kg.lead_order(), T.min_shared_urls, T.serp_top)


@query("snapshot_keywords", sql("listing", body="SELECT * FROM listing"))
def snapshot_keywords(spark, d):
    return snap(spark, d).keywords


@query(
    "position_groups",
    sql(
        "listing",
        body="""SELECT r.run_id, g.label, count(*) FILTER (
            CASE WHEN g.lo IS NULL THEN l.position IS NULL OR l.position > 20
                 ELSE l.position BETWEEN g.lo AND g.hi END) AS keywords
        FROM (SELECT DISTINCT run_id FROM listing) r
        CROSS JOIN (VALUES ('1-3', 1, 3), ('4-10', 4, 10), ('11-20', 11, 20),
          ('not in top 20', NULL, NULL)) g(label, lo, hi)
        JOIN listing l USING (run_id) GROUP BY 1, 2""",
    ),
)
def position_groups(spark, d):
    return snap(spark, d).groups


@query(
    "top_pages",
    sql(
        "listing",
        body="""SELECT run_id, url, visits, keywords, best_position, CAST(place AS INTEGER) AS place
        FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY visits DESC NULLS LAST,
            keywords DESC, best_position, url) AS place
          FROM (SELECT run_id, url, CAST(sum(visits) AS BIGINT) AS visits, count(*) AS keywords,
              min(position) AS best_position FROM listing WHERE ranked AND url <> ''
            GROUP BY 1, 2)) WHERE place <= 10""",
    ),
)
def top_pages(spark, d):
    return snap(spark, d).top_pages


@query(
    "top_page_keywords",
    sql(
        "listing",
        body="""
, best AS (SELECT run_id, url, CAST(place AS INTEGER) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY visits DESC NULLS LAST,
      keywords DESC, best_position, url) AS place
    FROM (SELECT run_id, url, sum(visits) AS visits, count(*) AS keywords,
      min(position) AS best_position FROM listing WHERE ranked AND url <> '' GROUP BY 1, 2))
  WHERE place <= 10)
SELECT run_id, place, url, position, keyword FROM listing JOIN best USING (run_id, url)
WHERE ranked""",
    ),
)
def top_page_keywords(spark, d):
    return snap(spark, d).page_keywords


@query(
    "snapshot_totals",
    sql(
        "listing",
        body="""SELECT run_id, domain, count(*) AS keywords_checked,
        count(*) FILTER (ranked) AS keywords_found, CAST(sum(visits) AS BIGINT) AS visits,
        count(visits) AS visits_keywords FROM listing GROUP BY 1, 2""",
    ),
)
def snapshot_totals(spark, d):
    return snap(spark, d).totals


@query(
    "snapshot_filter",
    sql(
        "listing",
        body="""SELECT run_id, keyword, position FROM listing
        WHERE NOT ranked AND contains(keyword, 'bolt')""",
    ),
)
def snapshot_filter(spark, d):
    rows = snapshot.filter_listing(snap(spark, d).keywords, "not", " Bolt ")
    return rows.select("run_id", "keyword", "position")


@query(
    "snapshot_csv",
    sql(
        "listing",
        body=f"""SELECT run_id, {_safe('keyword')} AS keyword, {_cell('position')} AS position, url,
        {_cell('searches')} AS bing_searches_per_month, searches_status AS bing_status,
        {_cell('estimate')} AS google_searches_estimate, {_cell('visits')} AS visits_estimate,
        {_cell('difficulty')} AS difficulty, {_cell('difficulty_band')} AS difficulty_band, intent,
        '' AS serp_features FROM listing""",
    ),
)
def snapshot_csv(spark, d):
    return sinks.snapshot_csv(snap(spark, d).keywords)


@query(
    "label_texts",
    sql(
        "metrics",
        body="""SELECT run_id, keyword,
          CASE difficulty_band WHEN 'low' THEN 'Low' WHEN 'medium' THEN 'Medium'
            WHEN 'high' THEN 'High' END AS competition,
          CASE intent WHEN 'commercial' THEN 'Comparing options'
            WHEN 'transactional' THEN 'Ready to sign up or buy'
            WHEN 'informational' THEN 'Want to learn' ELSE 'Mixed' END AS intent_text,
          CASE business_fit WHEN 3 THEN 'Exact fit' WHEN 2 THEN 'Good fit' WHEN 1 THEN 'Loose fit'
            WHEN 0 THEN 'No fit' ELSE 'Not judged' END AS fit_text,
          CASE WHEN difficulty >= 70 THEN 'Strong' WHEN difficulty >= 40 THEN 'Getting there'
            WHEN difficulty IS NOT NULL THEN 'Needs work' END AS verdict,
          CASE WHEN searches_status = 'measured' THEN format('{:,}', searches) ELSE 'Too low' END
            AS searches_text FROM metrics""",
    ),
)
def label_texts(spark, d):
    d_ = F.col("difficulty")
    return kg.metric_rows(*inputs(spark, d), GapSettings()).select(
        "run_id",
        "keyword",
        F.when(d_.isNotNull(), labels.competition(d_)).alias("competition"),
        labels.intent_text(F.col("intent")).alias("intent_text"),
        labels.fit_text(F.col("business_fit")).alias("fit_text"),
        F.when(d_.isNotNull(), labels.verdict(d_)).alias("verdict"),
        labels.searches_text(F.col("searches_status"), F.col("searches")).alias("searches_text"),
    )


@query(
    "gap_run_listing",
    sql(
        "gap", "run_domains",
        body=f"""
, added AS (SELECT run_id, least(count(*), {S.top_keywords}) AS to_add FROM gap
    WHERE list_has_any(categories, ['missing', 'weak', 'untapped'])
      AND coalesce(business_fit, {S.min_fit}) >= {S.min_fit} GROUP BY 1)
SELECT d.run_id, 'gap' AS kind,
  max(domain) FILTER (ord = 0) || ' vs ' || count(*) FILTER (ord > 0) || ' competitors' AS title,
  coalesce(max(to_add), 0) AS to_add
FROM run_domains d LEFT JOIN added USING (run_id) GROUP BY 1
ORDER BY 1 LIMIT 50""",
    ),
)
def gap_run_listing(spark, d):
    added = gap_result(spark, d).top.groupBy("run_id").agg(F.count("*").alias("to_add"))
    runs = (
        v.run_domains(spark, d)
        .groupBy("run_id")
        .agg(
            F.max(F.when(F.col("ord") == 0, F.col("domain"))).alias("ours"),
            F.count_if(F.col("ord") > 0).alias("rivals"),
        )
        .join(added, "run_id", "left")
        .select(
            "run_id",
            F.lit("gap").alias("kind"),
            F.lit("2026-01-01").cast("timestamp").alias("created_at"),
            sinks.gap_title(F.col("ours"), F.col("rivals")).alias("title"),
            F.coalesce("to_add", F.lit(0)).alias("to_add"),
        )
    )
    return sinks.list_runs(runs, size=50).drop("created_at")

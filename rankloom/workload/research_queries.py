"""Phrase research over parts and their result pages, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import candidates as cd
from rankloom.operators import phrases
from rankloom.plans.phrase_research import phrase_research
from rankloom.settings import GapSettings
from rankloom.workload import views as v
from rankloom.workload.gap_queries import CLOSE_KEYWORDS, WEAK_FLAGS, measured
from rankloom.workload.registry import query
from rankloom.workload.views_sql import T, greedy_heads, hashed, sql, url_key

_S = GapSettings(site_strength="established")
_CEILING = T.ceiling(_S.site_strength)

_RESEARCH = f"""
, names AS (SELECT DISTINCT run_id, regexp_replace(keyword, ' \\d+$', '') AS text FROM keywords),
name_words AS {hashed("names", "text")},
run_sums AS (SELECT run_id, bucket, sum(w) AS w FROM name_words GROUP BY 1, 2),
run_vector AS (SELECT run_id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY run_id)) AS w FROM run_sums),
keyword_words AS {hashed("keywords", "keyword")},
fits AS (SELECT k.run_id, k.text AS keyword, round_even(greatest(0e0, sum(k.w * coalesce(r.w, 0e0))), 4) AS fit
  FROM keyword_words k LEFT JOIN run_vector r ON r.run_id = k.run_id AND r.bucket = k.bucket GROUP BY 1, 2),
gated AS (SELECT d.run_id, d.keyword, CASE WHEN ord % 4 = 0 THEN 'seed;autocomplete' ELSE 'seed' END AS sources,
    searches AS volume, CASE WHEN ord % 4 = 0 THEN TRUE END AS in_autocomplete, coalesce(f.fit, 0e0) AS fit,
    searches >= {T.min_impressions} OR ord % 4 = 0 AS kept
  FROM demand d LEFT JOIN fits f USING (run_id, keyword)),
{WEAK_FLAGS},
judged AS (SELECT g.*, coalesce(p.difficulty, 0) AS difficulty, coalesce(i.intent, 'unknown') AS intent,
    coalesce(s.signals, []) AS signals, coalesce(s.bonus, 0e0) AS bonus
  FROM gated g LEFT JOIN profile p USING (run_id, keyword) LEFT JOIN intents i USING (run_id, keyword)
  LEFT JOIN spots s USING (run_id, keyword) WHERE g.kept),
survivors AS (SELECT * FROM judged WHERE difficulty <= {_CEILING}),
m AS (SELECT DISTINCT run_id, keyword, {url_key('url')} AS u FROM serp WHERE pos <= {T.serp_top}),
placed AS (SELECT run_id, keyword AS item, row_number() OVER (PARTITION BY run_id ORDER BY volume DESC, keyword) AS n
  FROM survivors),
{greedy_heads('SELECT run_id, item, n FROM placed', CLOSE_KEYWORDS)},
sums AS (SELECT s.run_id, h.head AS cluster, max(fit) AS fit, CAST(sum(volume) AS BIGINT) AS total_volume, count(*) AS members
  FROM survivors s JOIN headed h ON h.run_id = s.run_id AND h.item = s.keyword GROUP BY 1, 2),
won AS (SELECT c.*, s.difficulty, s.signals, s.volume, s.intent, log10(2e0 + total_volume) AS demand,
    least(1e0, greatest(0e0, 1e0 - s.difficulty / 100e0 + s.bonus)) AS win
  FROM sums c JOIN survivors s ON s.run_id = c.run_id AND s.keyword = c.cluster),
scored AS (SELECT *, round_even(fit * demand * win, 4) AS score FROM won),
best AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY score DESC, cluster) AS INTEGER)
    AS place FROM scored) WHERE place <= {T.phrases_per_run}),
chosen AS (SELECT run_id, place, cluster AS phrase, volume,
    CASE WHEN volume >= {T.min_impressions} THEN 'bing' ELSE 'autocomplete' END AS volume_source,
    difficulty, intent, members, score,
    CASE WHEN volume >= {T.min_impressions} THEN total_volume || ' Bing impressions/mo' ELSE 'in Google autocomplete' END
      || ' across ' || members || ' phrase(s), difficulty ' || difficulty || ', fit ' || printf('%.2f', round_even(fit, 2))
      || CASE WHEN len(signals) > 0 THEN '; ' || array_to_string(signals, ', ') ELSE '' END AS reason
  FROM best)
"""


def _sql(body: str) -> str:
    views = ("keywords", "demand", "serp", "top", "profile", "intents")
    return sql(*views, body=_RESEARCH + body).replace("WITH ", "WITH RECURSIVE ", 1)


def research_sources(spark, d) -> DataFrame:
    """Candidates of two sources: landed seeds and autocomplete."""
    kw = measured(spark, d)
    base = [
        "run_id", F.col("keyword").alias("phrase"), F.lit("seed").alias("source"),
        F.col("searches").alias("volume"), F.lit(None).cast("int").alias("difficulty"),
        F.lit("unknown").alias("intent"), F.lit(None).cast("boolean").alias("in_autocomplete"),
        "ord",
    ]
    seeds = kw.select(*base)
    auto = kw.filter("ord % 4 = 0").select(*base).withColumns(
        {
            "source": F.lit("autocomplete"),
            "volume": F.lit(None).cast("int"),
            "in_autocomplete": F.lit(True),
            "ord": F.col("ord") + 10_000_000,
        }
    )
    return seeds.unionByName(auto)


def run_vectors(spark, d) -> DataFrame:
    """(run_id, vector): the normalised sum of the vectors of a run's keywords, added up per word
    bucket, so that no row holds the words of a run."""
    names = v.keywords(spark, d).select(
        "run_id", F.lit(0).alias("page"), F.regexp_replace("keyword", r" \d+$", "").alias("text")
    )
    return phrases.page_vectors(names.distinct(), T).drop("page")


def _research(spark, d):
    return phrase_research(
        research_sources(spark, d), run_vectors(spark, d), v.shared_serp(spark, d),
        v.site_ranks(spark, d), _S, v.YEAR,
    )


@query(
    "ranked_clusters",
    _sql("""SELECT run_id, cluster, members, total_volume, difficulty, fit, round_even(demand, 4) AS demand,
      round_even(win, 4) AS winnability, score, array_to_string(signals, '; ') AS signals FROM scored"""),
)
def ranked_clusters(spark, d):
    return _research(spark, d).clusters.withColumn("signals", F.array_join("signals", "; "))


@query("chosen_phrases", _sql("SELECT * FROM chosen"))
def chosen_phrases(spark, d):
    return _research(spark, d).phrases


@query(
    "research_candidates",
    _sql(f"""SELECT g.run_id, g.keyword, g.sources, g.volume, g.in_autocomplete, g.fit,
      CASE WHEN NOT g.kept THEN 'no demand: ' || g.volume
          || ' Bing impressions < {T.min_impressions}, not in Google autocomplete'
        WHEN j.difficulty > {_CEILING} THEN 'difficulty ' || j.difficulty || ' > {_CEILING} ({_S.site_strength} site)'
        WHEN c.phrase IS NOT NULL THEN 'chosen: ' || c.reason
        WHEN s.cluster IS NOT NULL THEN 'cluster score ' || s.score || ' below top {T.phrases_per_run}'
        ELSE '' END AS reason, c.phrase IS NOT NULL AS chosen
    FROM gated g LEFT JOIN judged j USING (run_id, keyword)
    LEFT JOIN chosen c ON c.run_id = g.run_id AND c.phrase = g.keyword
    LEFT JOIN scored s ON s.run_id = g.run_id AND s.cluster = g.keyword"""),
)
def research_candidates(spark, d):
    return _research(spark, d).candidates.withColumn("sources", F.array_join("sources", ";"))


@query(
    "candidate_union",
    sql(
        "demand",
        body="""SELECT run_id, keyword, CASE WHEN ord % 4 = 0 THEN 'seed;autocomplete' ELSE 'seed'
          END AS sources, ord, searches AS volume,
          CASE WHEN ord % 4 = 0 THEN TRUE END AS in_autocomplete FROM demand""",
    ),
)
def candidate_union(spark, d):
    return cd.union_candidates(research_sources(spark, d)).select(
        "run_id", "keyword", F.array_join("sources", ";").alias("sources"), "ord", "volume",
        "in_autocomplete",
    )

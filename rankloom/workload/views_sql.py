"""The fixed views as SQL, for checking results with another engine."""

from __future__ import annotations

from rankloom import fixed_values as fv
from rankloom.settings import GapSettings

S = GapSettings()
T = S.thresholds
TODAY = "DATE '1998-06-01'"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(names) -> str:
    return "(" + ", ".join(lit(n) for n in names) + ")"


def number_list(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}e0" for v in values) + "]"


def authority(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"


def host(url: str) -> str:
    return f"regexp_replace({authority(url)}, ':[0-9]*$', '')"


def path(url: str) -> str:
    return (
        f"regexp_extract({url}, "
        "'^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
    )


def query_part(url: str) -> str:
    return f"regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1)"


def domain(url: str) -> str:
    return f"regexp_replace({authority(url)}, '^www\\.', '')"


def page_key(url: str) -> str:
    p = f"regexp_replace({path(url)}, '/+$', '')"
    return (
        f"(regexp_replace({host(url)}, '^www\\.', '') || CASE WHEN {p} = '' THEN '/' ELSE {p} END)"
    )


def url_key(url: str) -> str:
    bare = f"regexp_replace(lower({url}), '^https?://(www\\.)?', '')"
    return f"regexp_replace(regexp_extract({bare}, '^[^#?]*', 0), '/+$', '')"


def owned(name: str, target: str) -> str:
    return f"({name} = {target} OR ends_with({name}, '.' || {target}))"


def owned_by_any(name: str, names) -> str:
    return "(" + " OR ".join(owned(name, lit(n)) for n in names) + ")"


def page_type(url: str, title: str = "''") -> str:
    h, p = domain(url), path(url)
    text = f"({p} || ' ' || {title})"

    def has(what: str, pattern: str) -> str:
        return f"regexp_matches({what}, {lit('(?i)' + pattern)})"

    return f"""(CASE
      WHEN ends_with(lower({p}), '.pdf') THEN 'pdf'
      WHEN {has(p, fv.LOGIN_PATH)} THEN 'login'
      WHEN {owned_by_any(h, fv.VIDEO_HOSTS)} THEN 'video'
      WHEN {owned_by_any(h, fv.FORUM_HOSTS)} OR {has(p, fv.FORUM_PATH)} THEN 'forum'
      WHEN {has(text, fv.COMPARISON_TEXT)} THEN 'comparison'
      WHEN {has(text, fv.LISTICLE_TEXT)} THEN 'listicle'
      WHEN {has(text, fv.TOOL_TEXT)} THEN 'tool'
      WHEN {has(text, fv.GUIDE_TEXT)} THEN 'guide'
      WHEN {owned_by_any(h, fv.NEWS_HOSTS)} OR contains({p}, '/news/') THEN 'news'
      WHEN {has(p, fv.CATEGORY_PATH)} THEN 'category'
      WHEN {has(p, fv.PRODUCT_PATH)} THEN 'product'
      ELSE 'unknown' END)"""


def words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {lit(fv.WORD_PATTERN)})"


def stem(w: str) -> str:
    return f"(CASE WHEN ends_with({w}, 's') AND length({w}) > 3 THEN {w}[:-2] ELSE {w} END)"


def content_words(text: str) -> str:
    stop = "[" + ", ".join(lit(w) for w in fv.STOPWORDS) + "]"
    kept = f"list_filter({words(text)}, lambda w: NOT list_contains({stop}, w))"
    return f"list_transform({kept}, lambda w: {stem('w')})"


def hashed(items: str, text: str) -> str:
    """Entries (run_id, text, bucket, w) of the hashed vectors of a table's distinct texts."""
    return f"""(SELECT run_id, text, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY run_id, text)) AS w FROM (
      SELECT run_id, text, CAST(('0x' || right(md5(word), 2)) AS INTEGER) AS bucket, count(*) AS n FROM (
        SELECT run_id, {text} AS text, unnest({content_words(text)}) AS word
        FROM (SELECT DISTINCT run_id, {text} FROM {items})) GROUP BY 1, 2, 3))"""


def variant_key(text: str) -> str:
    joined = f"array_to_string(list_sort({content_words(text)}), ' ')"
    return f"coalesce(nullif({joined}, ''), {text})"


def width_sql(text: str) -> str:
    table = ", ".join(f"{lit(c)}: {w}" for c, w in fv.CHAR_WIDTHS.items())
    return (
        f"list_sum(list_transform(string_split({text}, ''), lambda c: "
        f"coalesce((MAP {{{table}}})[c], CASE WHEN unicode(c) >= {fv.WIDE_CHAR_FROM} "
        f"THEN {fv.WIDE_CHAR_WIDTH} ELSE {fv.DEFAULT_CHAR_WIDTH} END)))"
    )


def squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def ctr(p: str) -> str:
    curve = S.click_curve
    return (
        f"(CASE WHEN {p} BETWEEN 1 AND {len(curve)} THEN ({number_list(curve)})[{p}] "
        "ELSE 0e0 END)"
    )


def rounded(value: str) -> str:
    return f"CAST(round_even({value}, 0) AS INTEGER)"


def strength(kind: str, rank: str) -> str:
    steps = " ".join(f"WHEN {rank} <= {c} THEN {v!r}e0" for c, v in T.strength_by_rank)
    return (
        f"(CASE WHEN {kind} IN {in_list(fv.UGC_TYPES)} THEN {T.ugc_strength!r}e0 "
        f"WHEN {rank} IS NULL THEN {T.unlisted_strength!r}e0 {steps} "
        f"ELSE {T.unlisted_strength!r}e0 END)"
    )


def intent_of(kind: str) -> str:
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in fv.INTENT_OF_TYPE.items())
    return f"(CASE {kind} {cases} END)"


_URL = """'https://' || CASE k % 3 WHEN 0 THEN 'www.' WHEN 1 THEN 'blog.' ELSE '' END || 's' || k
  || '.example.com' || CASE k % 5 WHEN 0 THEN '/pricing' WHEN 1 THEN '/how-to-guide'
  WHEN 2 THEN '/best-10-tools' WHEN 3 THEN '/a-vs-b' ELSE '/forum/1' END"""

RATIO = f"{S.share_ratios[S.country]!r}e0"

_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "keywords": (
        (),
        """SELECT p_brand AS run_id, lower(p_name || ' ' || p_type) || ' ' || p_partkey AS keyword,
        CASE WHEN p_size % 5 <> 4 THEN p_size % 5 END AS business_fit, p_partkey AS ord FROM part""",
    ),
    "run_domains": (
        (),
        """SELECT run_id, o.ord, 's' || ((b * 5 + o.ord) % n) || '.example.com' AS domain
        FROM (SELECT DISTINCT p_brand AS run_id,
                CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS b FROM part) r,
             (SELECT count(*) AS n FROM supplier) c,
             (SELECT unnest([0, 1, 2, 3, 4]) AS ord) o""",
    ),
    "serp_k": (
        (),
        """SELECT ord, k, pos FROM (
          SELECT l_partkey AS ord, l_suppkey AS k, row_number() OVER (
            PARTITION BY l_partkey ORDER BY max(l_extendedprice) DESC, l_suppkey) AS pos
          FROM lineitem GROUP BY l_partkey, l_suppkey) WHERE pos <= 20""",
    ),
    "serp_url": (
        ("keywords", "serp_k"),
        f"""SELECT w.run_id, w.keyword, CAST(s.pos AS INTEGER) AS pos, CAST(s.pos AS INTEGER) AS rank,
        s.k, {_URL} AS url, 'Review ' || (2010 + s.k % 20) AS title
        FROM serp_k s JOIN keywords w USING (ord)""",
    ),
    "serp": (
        ("serp_url",),
        f"""SELECT *, {domain('url')} AS domain, {page_type('url', 'title')} AS page_type
        FROM serp_url""",
    ),
    "impressions": (
        (),
        """SELECT l_partkey AS ord, CAST(date_trunc('week', l_shipdate) AS DATE) AS week_date,
        CAST(sum(l_quantity) AS INTEGER) AS impressions FROM lineitem GROUP BY 1, 2""",
    ),
    "volumes": (
        ("impressions",),
        f"""SELECT ord, {rounded('sum(impressions) / 12e0 * (52e0 / 12e0)')} AS searches
        FROM impressions WHERE week_date > {TODAY} - INTERVAL 84 DAY AND week_date <= {TODAY}
        GROUP BY ord""",
    ),
    "demand": (
        ("keywords", "volumes"),
        """SELECT w.*, coalesce(v.searches, 0) AS searches
        FROM keywords w LEFT JOIN volumes v USING (ord)""",
    ),
    "site_ranks": (
        (),
        """SELECT 's' || s_suppkey || '.example.com' AS domain,
        CAST(pow(10, 1 + s_suppkey % 6) AS BIGINT) AS rank FROM supplier WHERE s_suppkey % 4 <> 0""",
    ),
    "positions": (
        ("keywords", "run_domains", "serp"),
        f"""SELECT w.run_id, w.keyword, d.ord, d.domain, b.hit.rank AS position,
          coalesce(b.hit.url, '') AS url
        FROM keywords w JOIN run_domains d USING (run_id)
        LEFT JOIN (
          SELECT s.run_id, s.keyword, x.ord, min({{'rank': s.rank, 'pos': s.pos, 'url': s.url}}) AS hit
          FROM serp s JOIN run_domains x
            ON s.run_id = x.run_id AND {owned('s.domain', 'x.domain')}
          GROUP BY 1, 2, 3) b ON b.run_id = w.run_id AND b.keyword = w.keyword AND b.ord = d.ord""",
    ),
    "top": (
        ("serp", "site_ranks"),
        f"""SELECT s.*, coalesce(a.rank, b.rank) AS site_rank,
          {strength('s.page_type', 'coalesce(a.rank, b.rank)')} AS strength
        FROM serp s LEFT JOIN site_ranks a ON a.domain = s.domain
        LEFT JOIN site_ranks b ON b.domain = regexp_replace(s.domain, '^[^.]*\\.', '')
        WHERE s.pos <= 10""",
    ),
    "profile": (
        ("top",),
        f"""SELECT run_id, keyword, CAST(count(*) AS INTEGER) AS results,
          {rounded('100e0 * list_reduce(list(strength ORDER BY pos), lambda a, b: a + b) / count(*)')}
            AS difficulty,
          CAST(count(*) FILTER (site_rank IS NULL AND page_type NOT IN {in_list(fv.UGC_TYPES)})
            AS INTEGER) AS small_sites
        FROM top GROUP BY 1, 2""",
    ),
    "intents": (
        ("top",),
        f"""SELECT run_id, keyword, arg_min(intent, {{'n': -n, 'p': p}}) AS intent FROM (
          SELECT run_id, keyword, {intent_of('page_type')} AS intent, count(*) AS n, min(pos) AS p
          FROM top GROUP BY 1, 2, 3) WHERE intent IS NOT NULL GROUP BY 1, 2""",
    ),
    "metrics": (
        ("demand", "profile", "intents"),
        f"""SELECT d.run_id, d.keyword, d.business_fit, d.ord AS kw_ord,
          CASE WHEN d.searches > 0 THEN d.searches END AS searches,
          CASE WHEN d.searches > 0 THEN 'measured' ELSE 'too_low' END AS searches_status,
          CASE WHEN d.searches > 0 THEN {rounded(f'd.searches * {RATIO}')} END AS estimate,
          CASE WHEN p.results >= {S.min_results} THEN p.difficulty END AS difficulty,
          CASE WHEN p.results >= {S.min_results} THEN
            CASE WHEN p.difficulty <= {S.band_low} THEN 'low'
                 WHEN p.difficulty <= {S.band_medium} THEN 'medium' ELSE 'high' END END
            AS difficulty_band,
          coalesce(i.intent, 'unknown') AS intent
        FROM demand d LEFT JOIN profile p USING (run_id, keyword)
        LEFT JOIN intents i USING (run_id, keyword)""",
    ),
    "sites": (
        ("positions", "metrics"),
        f"""SELECT p.*, {rounded(f"m.estimate * {ctr('p.position')}")} AS visits
        FROM positions p JOIN metrics m USING (run_id, keyword)""",
    ),
    "sides": (
        ("positions",),
        f"""SELECT run_id, keyword, max(position) FILTER (ord = 0) AS ours,
          count(*) FILTER (ord > 0) AS rivals, count(position) FILTER (ord > 0) AS ranked,
          min(position) FILTER (ord > 0) AS best, max(position) FILTER (ord > 0) AS worst,
          round_even(coalesce(sum({ctr('position')}) FILTER (ord > 0), 0), 4) AS proof
        FROM positions GROUP BY 1, 2""",
    ),
    "gap": (
        ("metrics", "sides"),
        f"""SELECT m.*, s.ours, s.rivals, s.ranked, s.best, s.proof,
          CASE WHEN m.estimate IS NOT NULL AND s.best IS NOT NULL THEN
            greatest(0, {rounded(f"m.estimate * ({ctr('s.best')} - {ctr('s.ours')})")}) END
            AS traffic_lift,
          list_filter([
            CASE WHEN ours IS NOT NULL AND rivals > 0 AND ranked = rivals THEN 'shared' END,
            CASE WHEN ours IS NULL AND rivals > 0 AND ranked = rivals THEN 'missing' END,
            CASE WHEN ours IS NOT NULL AND ranked > 0 AND worst < ours THEN 'weak' END,
            CASE WHEN ours IS NOT NULL AND ranked > 0 AND ours < best THEN 'strong' END,
            CASE WHEN ours IS NULL AND ranked > 0 THEN 'untapped' END,
            CASE WHEN ours IS NOT NULL AND ranked = 0 THEN 'unique' END],
            lambda c: c IS NOT NULL) AS categories
        FROM metrics m JOIN sides s USING (run_id, keyword)""",
    ),
    "listing": (
        ("metrics", "sites"),
        """SELECT s.run_id, s.domain, s.keyword, s.position, s.url, s.position IS NOT NULL AS ranked,
          m.searches, m.searches_status, m.estimate, s.visits, m.difficulty, m.difficulty_band,
          m.intent
        FROM sites s JOIN metrics m USING (run_id, keyword) WHERE s.ord = 0""",
    ),
    "sitemap": (
        (),
        """SELECT regexp_extract(lower(url), '^[a-z]+://(?:www\\.)?([^/?#]+)', 1) AS site,
          page_id AS pos, url,
          CAST(CAST(DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS DATE) AS VARCHAR) AS lastmod
        FROM pages""",
    ),
}


def sql(*views: str, body: str) -> str:
    """The body with the views it needs, and theirs, as common table expressions."""
    needed: dict[str, None] = {}

    def visit(name: str) -> None:
        for parent in _VIEWS[name][0]:
            visit(parent)
        needed.setdefault(name)

    for view in views:
        visit(view)
    parts = [f"{name} AS ({_VIEWS[name][1]})" for name in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def greedy_heads(items: str, close: str) -> str:
    """Greedy heads as SQL: `items` gives (run_id, item, n) numbered from 1 within a run, `close` gives
    (run_id, a, b) of close items as numbers, b before a. A recursive walk takes one item after the other:
    it joins the first of its close heads or becomes a head."""
    return f"""near AS (SELECT run_id, a, list(b) AS bs FROM ({close}) GROUP BY 1, 2),
lined AS (SELECT i.run_id, i.item, i.n, coalesce(bs, []) AS bs FROM ({items}) i
  LEFT JOIN near ON near.run_id = i.run_id AND near.a = i.n),
walk AS (
  SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS heads, CAST(0 AS BIGINT) AS head FROM lined
  UNION ALL
  SELECT w.run_id, l.n,
    CASE WHEN len(list_intersect(bs, heads)) = 0 THEN heads || [l.n] ELSE heads END,
    coalesce(list_min(list_intersect(bs, heads)), l.n)
  FROM walk w JOIN lined l ON l.run_id = w.run_id AND l.n = w.n + 1),
headed AS (SELECT w.run_id, l.item, h.item AS head FROM walk w
  JOIN lined l ON l.run_id = w.run_id AND l.n = w.n JOIN lined h ON h.run_id = w.run_id AND h.n = w.head)"""

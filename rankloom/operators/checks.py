"""Technical site checks: each a status (pass, warn, fail, unknown) and a detail per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom import fixed_values as fv
from rankloom.functions.robots import says_noindex
from rankloom.functions.snippet import snippet_check
from rankloom.functions.url import (
    canonical_from_link_header,
    host_of,
    no_www,
    same_page,
    same_page_key,
)
from rankloom.operators.sampling import with_robots
from rankloom.settings import Thresholds

PERMANENT = [301, 308]


def _ok(v: Column) -> Column:
    return (F.coalesce(v["status"], F.lit(0)) == 200) & (F.coalesce(v["error"], F.lit("")) == "")


def site_probes(probes: DataFrame, hops: DataFrame) -> DataFrame:
    """One row per site: its four address variants in order, their redirects, and `home`, where
    the first working address ends."""
    steps = hops.groupBy("domain", "variant_no").agg(
        F.array_sort(F.collect_list(F.struct("hop_no", "url", "status"))).alias("hops")
    )
    variant = F.struct("variant_no", "url", "status", "final_url", "error", "hops")
    sites = (
        probes.join(steps, ["domain", "variant_no"], "left")
        .groupBy("domain")
        .agg(F.array_sort(F.collect_list(variant)).alias("variants"))
    )
    first = F.try_element_at(F.filter("variants", _ok), F.lit(1))["final_url"]
    return sites.withColumn("home", F.coalesce(first, F.lit("")))


def site_rows(
    probes: DataFrame,
    hops: DataFrame,
    robots: DataFrame,
    rules: DataFrame,
    sitemaps: DataFrame,
    homepages: DataFrame,
    crawler: str = "googlebot",
) -> DataFrame:
    """Everything the checks read, one row per site.

    robots: domain, robots_status, robots_error, robots_too_large; rules: host, agent, allow,
    pattern; sitemaps: domain, sitemap_files, sitemap_urls; homepages: domain, page_status,
    page_error, page_too_large, blocks_us, final_url, link_header, x_robots, has_body, title,
    description, metas, canonical.
    """
    sites = site_probes(probes, hops)
    allowed = with_robots(
        sites.select("domain", F.col("home").alias("url")), rules, crawler
    ).select("domain", F.col("allowed").alias("home_allowed"))
    out = sites.join(allowed, "domain", "left")
    for table, flag in ((robots, "robots_seen"), (sitemaps, "sitemap_seen"), (homepages, "seen")):
        out = out.join(table.withColumn(flag, F.lit(True)), "domain", "left").withColumn(
            flag, F.coalesce(flag, F.lit(False))
        )
    return out


def _text(*parts) -> Column:
    return F.concat(
        *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    )


def _check(key: str, *cases: tuple) -> Column:
    """cases: (condition, status, detail); the last condition is None."""
    status = detail = None
    for when, state, text in cases[:-1]:
        text = text if isinstance(text, Column) else F.lit(text)
        state = state if isinstance(state, Column) else F.lit(state)
        status = F.when(when, state) if status is None else status.when(when, state)
        detail = F.when(when, text) if detail is None else detail.when(when, text)
    _, state, text = cases[-1]
    text = text if isinstance(text, Column) else F.lit(text)
    state = state if isinstance(state, Column) else F.lit(state)
    status = state if status is None else status.otherwise(state)
    detail = text if detail is None else detail.otherwise(text)
    return F.struct(F.lit(key).alias("key"), status.alias("status"), detail.alias("detail"))


def _https() -> Column:
    home = F.col("home")
    codes = F.transform(
        F.filter("variants", lambda v: v["status"].isNotNull()),
        lambda v: v["status"].cast("string"),
    )
    return _check(
        "https",
        (
            (home == "") & (F.size(codes) > 0),
            "unknown",
            _text("No address showed a page (HTTP ", F.array_join(codes, ", "),
                  "). The site may block automated visits."),
        ),
        (home == "", "unknown", "No address of the site answered."),
        (F.startswith(home, F.lit("https://")), "pass", _text("The site settles on ", home, ".")),
        (None, "fail", _text("The site settles on ", home, ", without HTTPS.")),
    )


def _http_redirect() -> Column:
    plain = F.try_element_at("variants", F.lit(3))
    error = F.coalesce(plain["error"], F.lit(""))
    final = F.coalesce(plain["final_url"], F.lit(""))
    code = plain["status"]
    answered = F.when(code == 200, "").otherwise(_text(" (it answered HTTP ", code, ")"))
    address = _text("http://", F.col("domain"))
    why = F.when(error != "", error).otherwise("no answer")
    return _check(
        "http_redirect",
        (
            (error != "") | code.isNull() | (final == ""),
            "unknown",
            _text(address, " did not answer (", why, ")."),
        ),
        (
            F.startswith(final, F.lit("https://")),
            "pass",
            _text(address, " redirects to ", final, answered, "."),
        ),
        (None, "fail", _text(address, " stays on ", final, " (HTTP ", code, ").")),
    )


def _one_address() -> Column:
    finals = F.transform(F.filter("variants", _ok), lambda v: v["final_url"])
    keys = F.transform(finals, same_page_key)
    distinct = F.filter(
        finals, lambda f, i: F.array_position(keys, same_page_key(f)) == i + 1
    )
    missing = F.size("variants") - F.size(finals)
    extra = F.when(missing > 0, _text(" (", missing, " of 4 addresses did not answer.)")).otherwise(
        ""
    )
    return _check(
        "one_address",
        (F.size(finals) == 0, "unknown", "No address answered."),
        (
            F.size(distinct) > 1,
            "warn",
            _text("These addresses show the site without redirecting to one another: ",
                  F.array_join(distinct, ", "), ". Google may treat them as duplicates."),
        ),
        (
            None,
            "pass",
            _text("All working addresses lead to ", F.try_element_at(distinct, F.lit(1)), ".",
                  extra),
        ),
    )


def _permanent() -> Column:
    none = F.array().cast("array<struct<hop_no:int,url:string,status:int>>")
    hops = F.flatten(
        F.transform(F.filter("variants", _ok), lambda v: F.coalesce(v["hops"], none))
    )
    temporary = F.array_distinct(
        F.transform(
            F.filter(hops, lambda h: ~h["status"].isin(PERMANENT)),
            lambda h: _text(h["url"], " (HTTP ", h["status"], ")"),
        )
    )
    return _check(
        "permanent_redirects",
        (
            F.size(temporary) > 0,
            "warn",
            _text("Temporary redirects: ", F.array_join(temporary, ", "),
                  ". Google recommends 301 or 308 for a permanent move."),
        ),
        (F.size(hops) == 0, "pass", "No redirects are needed."),
        (None, "pass", "All redirects use 301 or 308."),
    )


def _robots() -> Column:
    code, error = F.col("robots_status"), F.coalesce("robots_error", F.lit(""))
    why = F.when(error != "", error).otherwise(_text("HTTP ", F.coalesce(code, F.lit(0))))
    extra = F.when(
        F.col("robots_too_large"), " (Google reads only the first 500 KiB of the file.)"
    ).otherwise("")
    return _check(
        "robots",
        (~F.col("robots_seen") | (F.col("home") == ""), "unknown", "The site did not answer."),
        (
            (error != "") | code.isNull() | (code >= 500) | (code == 429),
            "warn",
            _text("robots.txt could not be read (", why,
                  "). Google stops crawling until it can."),
        ),
        (code.isin(404, 410), "pass", "No robots.txt: every page may be crawled."),
        (
            code >= 400,
            "pass",
            _text("robots.txt answered HTTP ", code, "; Google treats that as no rules."),
        ),
        (~F.col("home_allowed"), "fail", "robots.txt blocks Googlebot from the homepage."),
        (None, "pass", _text("Googlebot may crawl the homepage.", extra)),
    )


def _sitemap() -> Column:
    files, urls = F.col("sitemap_files"), F.col("sitemap_urls")
    plural = F.when(files == 1, "").otherwise("s")
    return _check(
        "sitemap",
        (~F.col("sitemap_seen"), "unknown", "The site could not be read."),
        (
            (files > 0) & (urls > 0),
            "pass",
            _text(urls, " page addresses listed in ", files, " sitemap file", plural, "."),
        ),
        (files > 0, "warn", "The sitemap lists no pages of this site."),
        (None, "warn", "No sitemap found. A sitemap helps Google find every page."),
    )


def _homepage(t: Thresholds) -> list[Column]:
    readable = (
        F.col("seen")
        & (F.coalesce("page_status", F.lit(0)) == 200)
        & (F.coalesce("page_error", F.lit("")) == "")
        & F.coalesce("has_body", F.lit(False))
    )
    why = (
        F.when(
            F.coalesce("blocks_us", F.lit(False)),
            "Robots.txt asks crawlers like ours not to read the homepage.",
        )
        .when(F.coalesce("page_too_large", F.lit(False)), "The page was too large.")
        .otherwise("The homepage could not be read.")
    )
    unread = (~readable, "unknown", why)
    header = says_noindex(F.col("x_robots"), header=True)
    meta = says_noindex(F.col("metas"))
    where = F.when(header, "an X-Robots-Tag header").otherwise("a robots meta tag")
    indexable = _check(
        "indexable",
        unread,
        (
            header | meta,
            "fail",
            _text("The homepage says noindex in ", where, ": Google drops it from search."),
        ),
        (None, "pass", "No noindex rule."),
    )

    title = F.coalesce("title", F.lit(""))
    snippet = snippet_check(title, F.col("description"), None, t)
    note = F.try_element_at(
        F.filter(snippet["reasons"], lambda r: F.startswith(r, F.lit("title"))), F.lit(1)
    )
    tail = F.when(note.isNotNull(), _text(": ", note, ".")).otherwise(".")
    shown = _text("“", title, "” (", snippet["title_chars"], " characters, ",
                  snippet["title_px"], "px)", tail)
    titled = _check(
        "title",
        unread,
        (title == "", "fail", "The homepage has no title."),
        (None, F.when(snippet["title_ok"], "pass").otherwise("warn"), shown),
    )

    n = F.length(F.coalesce("description", F.lit("")))
    fits = n.between(t.description_min, t.description_max)
    described = _check(
        "description",
        unread,
        (n == 0, "warn", "No meta description. Google writes its own snippet from the page."),
        (fits, "pass", _text(n, " characters.")),
        (
            None,
            "warn",
            _text(n, f" characters; aim for {t.description_min} to {t.description_max}."),
        ),
    )

    final = F.col("final_url")
    canonical = F.coalesce(
        F.nullif("canonical", F.lit("")), canonical_from_link_header(F.col("link_header"), final)
    )
    pointed = _check(
        "canonical",
        unread,
        (
            canonical.isNull(),
            "warn",
            "No canonical tag. Google recommends one on the page itself.",
        ),
        (same_page(canonical, final), "pass", "Points to the homepage itself."),
        (
            no_www(host_of(canonical)) != F.col("domain"),
            "warn",
            _text("Points to another site: ", canonical, "."),
        ),
        (
            None,
            "warn",
            _text("Points to ", canonical, ", not to the homepage address ", final, "."),
        ),
    )
    return [indexable, titled, described, pointed]


def site_checks(rows: DataFrame, t: Thresholds) -> DataFrame:
    """(domain, key, status, detail): ten rows per site, from one pass over site_rows."""
    checks = [
        _https(), _http_redirect(), _one_address(), _permanent(), _robots(), _sitemap(),
        *_homepage(t),
    ]
    return rows.select("domain", F.inline(F.array(*checks)))


def check_counts(checks: DataFrame) -> DataFrame:
    """Per site: how many checks have each status."""
    return checks.groupBy("domain").agg(
        *[F.count_if(F.col("status") == x).alias(x) for x in fv.CHECK_STATUSES]
    )

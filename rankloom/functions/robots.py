"""Crawler-rule columns: noindex values, robots.txt fetch outcomes and rule matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom import fixed_values as fv
from rankloom.functions.text import regex_literal


def says_noindex(values: Column, header: bool = False, crawler: str = "googlebot") -> Column:
    """`noindex` or `none` for all crawlers or this one. In a header a rule may name a crawler
    first; the rules after it, in the same header, belong to that crawler."""

    def one_value(value: Column) -> Column:
        start = F.struct(F.lit("").alias("agent"), F.lit(False).alias("hit"))

        def step(acc: Column, raw: Column) -> Column:
            part = F.trim(raw)
            name = F.trim(F.substring_index(part, ":", 1))
            named = F.contains(part, F.lit(":")) if header else F.lit(False)
            valued = named & name.isin(fv.ROBOTS_VALUE_RULES)
            agent = F.when(named & ~valued, name).otherwise(acc["agent"])
            rule = F.when(named, F.trim(F.regexp_replace(part, r"^[^:]*:", ""))).otherwise(part)
            blocked = ~valued & rule.isin("noindex", "none") & agent.isin("", crawler)
            return F.struct(agent.alias("agent"), (acc["hit"] | blocked).alias("hit"))

        return F.aggregate(F.split(F.lower(value), ","), start, step, lambda acc: acc["hit"])

    return F.coalesce(F.exists(values, one_value), F.lit(False))


def robots_outcome(status: Column, too_large: Column) -> Column:
    """"rules", "allow_all" or "deny_all" for a robots.txt answer."""
    unreachable = status.isNull() | (status >= 500) | (status == 429) | too_large
    return (
        F.when(unreachable | status.isin(401, 403), "deny_all")
        .when(status >= 400, "allow_all")
        .otherwise("rules")
    )


def rule_regex(pattern: Column) -> Column:
    """A robots path rule as a regular expression: * matches anything, a final $ ends it."""
    body = F.regexp_replace(pattern, r"\$$", "")
    literal = F.replace(regex_literal(body), F.lit(r"\*"), F.lit(".*"))
    return F.concat(
        F.lit("^"), literal, F.when(F.endswith(pattern, F.lit("$")), "$").otherwise("")
    )


def rule_matches(path: Column, pattern: Column) -> Column:
    """Plain prefixes need no regular expression, which keeps the common case cheap."""
    special = pattern.rlike(r"[*$]")
    return F.when(special, F.regexp_like(path, rule_regex(pattern))).otherwise(
        F.startswith(path, pattern)
    )


def allowed_by(path: Column, rules: Column) -> Column:
    """Longest matching rule wins, allow on ties; no matching rule allows. `rules` is an array of
    struct(pattern, allow)."""
    hits = F.transform(
        F.filter(rules, lambda r: (r["pattern"] != "") & rule_matches(path, r["pattern"])),
        lambda r: F.struct(F.length(r["pattern"]).alias("n"), r["allow"].alias("allow")),
    )
    return F.coalesce(F.array_max(hits)["allow"], F.lit(True))

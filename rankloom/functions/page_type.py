"""Page-type classifier: ordered rules over path, title, host and schema.org type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom import fixed_values as fv
from rankloom.functions.binding import bind
from rankloom.functions.url import authority_of, no_www, path_of


def _has(text: Column, pattern: str) -> Column:
    return text.rlike("(?iU)" + pattern)


def _host_in(host: Column, names: list[str]) -> Column:
    """The host is one of the names or below one, as a single pattern."""
    options = "|".join(n.replace(".", "[.]") for n in names)
    return host.rlike(rf"(^|\.)({options})$")


def guess_page_type(
    url: Column, title: Column | None = None, schema_type: Column | None = None
) -> Column:
    """First matching rule wins; "unknown" when none does."""
    shown = F.lit("") if title is None else F.coalesce(title, F.lit(""))
    kind = F.lit("") if schema_type is None else F.lower(F.coalesce(schema_type, F.lit("")))
    parts = F.struct(
        no_www(authority_of(url)).alias("host"),
        path_of(url).alias("path"),
        shown.alias("title"),
        kind.alias("kind"),
    )
    with_text = bind(
        parts,
        lambda x: F.struct(
            x["host"].alias("host"),
            x["path"].alias("path"),
            F.concat(x["path"], F.lit(" "), x["title"]).alias("text"),
            x["kind"].alias("kind"),
        ),
    )
    return bind(with_text, lambda x: _rules(x["host"], x["path"], x["text"], x["kind"]))


def _rules(host: Column, path: Column, text: Column, kind: Column) -> Column:
    by_schema = F.create_map(*[F.lit(x) for kv in fv.SCHEMA_PAGE_TYPE.items() for x in kv])
    known = F.try_element_at(by_schema, kind)
    return (
        F.when(F.endswith(F.lower(path), F.lit(".pdf")), "pdf")
        .when(_has(path, fv.LOGIN_PATH), "login")
        .when(_host_in(host, fv.VIDEO_HOSTS), "video")
        .when(_host_in(host, fv.FORUM_HOSTS) | _has(path, fv.FORUM_PATH), "forum")
        .when(known.isNotNull(), known)
        .when(_has(text, fv.COMPARISON_TEXT), "comparison")
        .when(_has(text, fv.LISTICLE_TEXT), "listicle")
        .when(_has(text, fv.TOOL_TEXT), "tool")
        .when(_has(text, fv.GUIDE_TEXT), "guide")
        .when(_host_in(host, fv.NEWS_HOSTS) | F.contains(path, F.lit("/news/")), "news")
        .when(_has(path, fv.CATEGORY_PATH), "category")
        .when(_has(path, fv.PRODUCT_PATH), "product")
        .otherwise("unknown")
    )

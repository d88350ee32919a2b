"""URL and domain columns. All regular-expression based: a malformed URL gives null or an empty
part, never an error, and everything stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom import fixed_values as fv
from rankloom.functions.binding import bind

_AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))


def authority_of(url: Column) -> Column:
    """Host with user info and port, lower-cased."""
    return F.lower(F.regexp_extract(url, _AUTHORITY, 1))


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(authority_of(url), r"^.*@", ""), r":\d*$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def no_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def domain_of(url: Column) -> Column:
    """Host of a URL without www; a port stays."""
    return no_www(authority_of(url))


def bare_domain(domain: Column) -> Column:
    return F.regexp_replace(no_www(F.lower(F.trim(domain))), r"\.+$", "")


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def url_key(url: Column) -> Column:
    """Overlap key: no scheme, www, fragment, query or trailing slashes."""
    bare = F.regexp_replace(F.lower(url), r"^https?://(www\.)?", "")
    return F.regexp_replace(F.regexp_extract(bare, r"^[^#?]*", 0), r"/+$", "")


def page_key(url: Column) -> Column:
    """Page identity: host without www plus the path, whose case counts."""
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return F.concat(no_www(host_of(url)), F.when(path == "", "/").otherwise(path))


def owns(domain: Column, target: Column) -> Column:
    """blog.x.com belongs to x.com, notx.com does not."""
    d, t = no_www(F.lower(domain)), no_www(F.lower(target))
    return (d == t) | F.endswith(d, F.concat(F.lit("."), t))


def domain_parents(domain: Column) -> Column:
    """a.b.co -> [a.b.co, b.co]: the domain, then its parents down to two labels."""
    def chain(labels: Column) -> Column:
        n = F.size(labels)
        return F.when(
            n >= 2,
            F.transform(
                F.sequence(F.lit(1), n - 1),
                lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."),
            ),
        ).otherwise(F.array().cast("array<string>"))

    return bind(F.split(no_www(F.lower(domain)), r"\."), chain)


def ownership_names(domain: Column) -> Column:
    """Every name that owns this domain; one-label names own themselves."""
    name = no_www(F.lower(domain))
    return F.when(F.contains(name, F.lit(".")), domain_parents(domain)).otherwise(F.array(name))


def in_domains(domain: Column, names: list[str]) -> Column:
    """Owned by any of a fixed list of names."""
    return F.arrays_overlap(ownership_names(domain), F.array(*[F.lit(n) for n in names]))


def brand_label(domain: Column) -> Column:
    """The label in front of the public suffix, whatever stands before it."""
    labels = F.split(F.lower(domain), r"\.")
    n = F.size(labels)
    two_part_suffix = (
        (n >= 3)
        & (F.length(F.try_element_at(labels, F.lit(-1))) == 2)
        & F.try_element_at(labels, F.lit(-2)).isin(fv.SECOND_LEVEL_LABELS)
    )
    return (
        F.when(two_part_suffix, F.try_element_at(labels, F.lit(-3)))
        .when(n >= 2, F.try_element_at(labels, F.lit(-2)))
        .otherwise(F.try_element_at(labels, F.lit(1)))
    )


def site_origin(raw: Column) -> Column:
    """struct(domain, origin) of what a user typed; null when it is not a web address."""
    text = F.trim(raw)
    url = F.when(text.rlike(r"^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    host = F.regexp_replace(host_of(url), r"\.+$", "")
    return F.when(
        (host != "") & F.contains(host, F.lit(".")),
        F.struct(
            no_www(host).alias("domain"), F.concat(F.lit("https://"), host).alias("origin")
        ),
    )


def url_origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)


def segments(url: Column) -> Column:
    return F.filter(F.split(F.lower(path_of(url)), "/"), lambda s: s != "")


def same_page_key(url: Column) -> Column:
    """Equal for two addresses of one page: host case and trailing slashes are ignored, the
    scheme and the query string count."""
    return F.concat_ws(
        "\u0001",
        scheme_of(url),
        host_of(url),
        F.regexp_replace(path_of(url), r"/+$", ""),
        query_of(url),
    )


def same_page(a: Column, b: Column) -> Column:
    return same_page_key(a) == same_page_key(b)


def variant_urls(domain: Column) -> Column:
    """The four ways people type a site's address."""
    return F.array(
        *[
            F.concat(F.lit(prefix), domain, F.lit("/"))
            for prefix in ("https://", "https://www.", "http://", "http://www.")
        ]
    )


def resolve(href: Column, base: Column) -> Column:
    """Absolute form of a link target: absolute, //host, /rooted, ?query, #part or relative."""
    link = F.trim(href)
    base_path = path_of(base)
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme_of(base), F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(url_origin(base), link))
        .when(link == "", base)
        .when(F.startswith(link, F.lit("#")), F.concat(without_fragment(base), link))
        .when(F.startswith(link, F.lit("?")), F.concat(url_origin(base), base_path, link))
        .otherwise(
            F.concat(url_origin(base), F.when(folder == "", "/").otherwise(folder), link)
        )
    )


def canonical_from_link_header(link: Column, base: Column) -> Column:
    """First `<target>; rel="canonical"` of an HTTP Link header, made absolute."""
    parts = F.filter(
        F.split(link, ","),
        lambda p: p.rlike(r"^\s*<[^>]+>\s*;")
        & F.regexp_extract(p, r"^\s*<[^>]+>\s*;(.*)", 1).rlike(
            r'(?i)rel\s*=\s*"?[^";]*\bcanonical\b'
        ),
    )
    first = F.try_element_at(parts, F.lit(1))
    return resolve(F.regexp_extract(first, r"^\s*<([^>]+)>", 1), base)


def skip_reason(url: Column, domain: Column) -> Column:
    """Why a sitemap URL is not a page worth reading; null keeps it."""
    parts = F.struct(
        scheme_of(url).alias("scheme"),
        domain_of(url).alias("domain"),
        query_of(url).alias("query"),
        F.lower(path_of(url)).alias("path"),
        segments(url).alias("segs"),
    )
    return bind(parts, lambda x: _skip_rules(x, domain))


def _skip_rules(x: Column, site: Column) -> Column:
    path, segs = x["path"], x["segs"]
    endings = "|".join(e.replace(".", "[.]") for e in fv.SKIP_EXTENSIONS)

    def unwanted(seg: Column) -> Column:
        hit = seg.isin(fv.SKIP_SEGMENTS)
        for prefix in fv.SKIP_PREFIXES:
            hit = hit | F.startswith(seg, F.lit(prefix))
        for part in fv.SKIP_CONTAINS:
            hit = hit | F.contains(seg, F.lit(part))
        return hit

    bad = F.try_element_at(F.filter(segs, unwanted), F.lit(1))
    return (
        F.when(~x["scheme"].isin("http", "https") | (x["domain"] != site), "other site")
        .when(x["query"] != "", "query string")
        .when(F.contains(path, F.lit("http:")) | F.contains(path, F.lit("https:")), "broken link")
        .when(path.rlike(f"({endings})$") | path.rlike(fv.VERIFICATION_PATH), "not a web page")
        .when(path.rlike(fv.PAGINATION_PATH), "pagination")
        .when(
            (F.size(segs) == 1) & F.try_element_at(segs, F.lit(1)).isin(fv.LISTING_SECTIONS),
            "list page",
        )
        .when(bad.isNotNull(), F.concat(F.lit("skipped section '"), bad, F.lit("'")))
    )

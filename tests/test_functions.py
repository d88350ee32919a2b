import pytest
from pyspark.sql import functions as F

from rankloom.functions import labels, numeric, robots, snippet, text, url
from rankloom.functions.page_type import guess_page_type
from rankloom.settings import GapSettings, SnapshotSettings, Thresholds

S = GapSettings()
T = Thresholds()


def test_url_keys(values):
    rows = ["https://www.X.com/A/?q=1#f", "http://blog.x.com/a//", "not a url"]
    assert values(url.url_key, "u string", rows) == ["x.com/a", "blog.x.com/a", "not a url"]
    assert values(url.page_key, "u string", rows[:2]) == ["x.com/A", "blog.x.com/a"]
    assert values(url.page_key, "u string", ["https://x.com"]) == ["x.com/"]


def test_ownership(values):
    rows = [("www.zeto.com", "zeto.com"), ("blog.zeto.com", "zeto.com"), ("notzeto.com", "zeto.com")]
    assert values(url.owns, "d string, t string", rows) == [True, True, False]
    assert values(url.domain_parents, "d string", ["www.a.b.co.uk", "localhost"]) == [
        ["a.b.co.uk", "b.co.uk", "co.uk"],
        [],
    ]


def test_brand_label(values):
    rows = ["zeto.com", "app.zeto.com", "zeto.co.uk", "shop.com.np", "localhost"]
    assert values(url.brand_label, "d string", rows) == ["zeto", "zeto", "zeto", "shop", "localhost"]


def test_site_origin(values):
    rows = ["http://www.Site.com/x", "site.com", "nonsense"]
    got = values(url.site_origin, "d string", rows)
    assert got[0]["domain"] == "site.com" and got[0]["origin"] == "https://www.site.com"
    assert got[1]["origin"] == "https://site.com" and got[2] is None


def test_same_page_and_link_header(values):
    rows = [
        ("https://Site.com", "https://site.com/"),
        ("http://site.com/", "https://site.com/"),
        ("https://site.com/?a=1", "https://site.com/"),
    ]
    assert values(url.same_page, "a string, b string", rows) == [True, False, False]
    links = [
        ('<https://x.com/a>; rel="prev", </home>; rel="canonical"', "https://x.com/p"),
        ("", "https://x.com/"),
    ]
    assert values(url.canonical_from_link_header, "l string, b string", links) == [
        "https://x.com/home",
        None,
    ]


@pytest.mark.parametrize(
    "address,reason",
    [
        ("https://x.com/services/", None),
        ("https://y.com/services/", "other site"),
        ("https://x.com/a?b=1", "query string"),
        ("https://x.com/https:/cal.com/z", "broken link"),
        ("https://x.com/file.PDF", "not a web page"),
        ("https://x.com/google0123456789abcdef.html", "not a web page"),
        ("https://x.com/blog/page/2/", "pagination"),
        ("https://x.com/blog/", "list page"),
        ("https://x.com/blog/post", None),
        ("https://x.com/tag/a", "skipped section 'tag'"),
        ("https://x.com/privacy-policy", "skipped section 'privacy-policy'"),
        ("https://x.com/ebook-thank-you", "skipped section 'ebook-thank-you'"),
    ],
)
def test_skip_reason(values, address, reason):
    assert values(lambda u: url.skip_reason(u, F.lit("x.com")), "u string", [address]) == [reason]


@pytest.mark.parametrize(
    "address,title,schema,kind",
    [
        ("https://x.com/a.pdf", "", "", "pdf"),
        ("https://x.com/login", "", "", "login"),
        ("https://m.youtube.com/watch", "", "", "video"),
        ("https://x.com/community/q", "", "", "forum"),
        ("https://x.com/a", "", "HowTo", "guide"),
        ("https://x.com/a", "Moxo vs Clinked", "", "comparison"),
        ("https://x.com/a", "10 best portals", "", "listicle"),
        ("https://x.com/roi-calculator", "", "", "tool"),
        ("https://x.com/how-to-do", "", "", "guide"),
        ("https://techcrunch.com/a", "", "", "news"),
        ("https://x.com/category/a", "", "", "category"),
        ("https://x.com/pricing", "", "", "product"),
        ("https://x.com", "", "", "product"),
        ("https://x.com/zzz", "", "", "unknown"),
    ],
)
def test_page_types(values, address, title, schema, kind):
    got = values(guess_page_type, "u string, t string, s string", [(address, title, schema)])
    assert got == [kind]


def test_clean_phrase(values):
    rows = ["  Client   Portal! ", "https://x.com", "zeto login", "12 34", "a b c d e f g h", "café menü", "-x-"]
    assert values(text.clean_phrase, "p string", rows) == [
        "client portal", None, None, None, None, "café menü", "x",
    ]


def test_variant_key(values):
    rows = ["client portals software", "software for client portal", "the of"]
    assert values(text.variant_key, "p string", rows) == [
        "client portal software", "client portal software", "the of",
    ]


def test_contains_brand(values):
    rows = [
        ("best zeto app", "zeto"), ("zetos pricing", "zeto"), ("xzeto", "zeto"),
        ("hub nest login", "hubnest"), ("a+b tool", "a+b"),
    ]
    assert values(text.contains_brand, "p string, t string", rows) == [
        True, True, False, True, True,
    ]


def test_truncate_and_passages(values):
    assert values(lambda t: text.truncate_words(t, 3), "t string", ["a b\nc d\ne"]) == ["a b\nc"]
    page = "one two three\n\nfour five\nsix seven eight nine ten eleven twelve"
    assert values(lambda t: text.passages(t, 5), "t string", [page, "", "  \n "]) == [
        ["one two three four five", "six seven eight nine ten", "eleven twelve"], [], [],
    ]
    # what is left of a long paragraph stays open for the next one
    assert values(lambda t: text.passages(t, 5), "t string", ["a b c d e f g\nh i\nj k"]) == [
        ["a b c d e", "f g h i", "j k"],
    ]


def test_ngrams(values):
    got = values(text.sentence_grams, "t string", ["The client portal. Portal for 24 clients"])[0]
    assert sorted(got) == ["client portal"]


def test_phrase_counts_and_placeholders(values):
    assert values(text.phrase_count, "t string, p string", [("Portal portals portal.", "portal")]) == [2]
    assert values(text.placeholders, "t string", ["a [ADD: x] b [ADD: x] [ADD: y]"]) == [
        ["[ADD: x]", "[ADD: y]"]
    ]
    assert values(text.newest_year, "t string", ["2019 and 2024", "none"]) == [2024, None]


def test_autocomplete(values):
    rows = [("a b", ["a b"]), ("a b", ["a b c"]), ("a b", ["a bc"]), ("a b", None)]
    assert values(text.in_autocomplete, "p string, s array<string>", rows) == [
        True, True, False, None,
    ]


def test_click_rates_and_estimates(values):
    assert S.click_curve[6:19] == [0.0046] * 13 and S.click_curve[19] == 0.0027
    assert values(lambda p: numeric.ctr_at(p, S), "p int", [1, 12, 21, 0, None]) == [
        0.2002, 0.0046, 0.0, 0.0, 0.0,
    ]
    ratio = S.share_ratios["US"]
    visits = values(
        lambda n, p: numeric.half_even_int(
            numeric.half_even_int(n * F.lit(ratio)) * numeric.ctr_at(p, S)
        ),
        "n int, p int",
        [(134, 12), (134, 1), (100, 3), (134, None)],
    )
    assert visits == [6, 257, 37, 0]


def test_bands_and_labels(values):
    assert values(lambda d: labels.band(d, S), "d int", [30, 31, 55, 56, None]) == [
        "low", "medium", "medium", "high", None,
    ]
    snap = SnapshotSettings()
    rows = [("largest_contentful_paint", 2500.0), ("cumulative_layout_shift", 0.2), ("interaction_to_next_paint", 501.0)]
    assert values(lambda m, p: labels.vital_status(m, p, snap), "m string, p double", rows) == [
        "good", "needs work", "poor",
    ]


@pytest.mark.parametrize(
    "ours,rivals,expected",
    [
        (3, [5, 9], ["shared", "strong"]),
        (9, [3, 5], ["shared", "weak"]),
        (5, [3, 9], ["shared"]),
        (None, [3, 5], ["missing", "untapped"]),
        (None, [3, None], ["untapped"]),
        (4, [None, None], ["unique"]),
        (None, [None, None], []),
    ],
)
def test_gap_categories(values, ours, rivals, expected):
    known = [p for p in rivals if p is not None]
    row = (ours, len(known), len(rivals), min(known, default=None), max(known, default=None))
    got = values(labels.gap_categories, "o int, r int, c int, b int, w int", [row])
    assert sorted(got[0]) == sorted(expected)


def test_pixel_width_and_snippet(values):
    assert values(snippet.pixel_width, "t string", ["il", "", "漢字", "W*"]) == [9, 0, 40, 27]
    got = values(
        lambda t, d, p: snippet.snippet_check(t, d, p, T),
        "t string, d string, p string",
        [("Client portal software for busy firms", "x" * 80, "client portal"), ("Short", "y", "z")],
    )
    assert got[0]["title_ok"] and got[0]["phrase_first_in_title"] and not got[0]["phrase_in_payoff"]
    assert got[1]["passed"] is False and len(got[1]["reasons"]) == 4


def test_noindex(values):
    header = [(["otherbot: noindex"],), (["googlebot: nofollow, noindex"],), (["max-snippet: 50, noindex"],), ([],)]
    assert values(lambda v: robots.says_noindex(v, True), "v array<string>", header) == [
        False, True, True, False,
    ]
    assert values(robots.says_noindex, "v array<string>", [(["index"],), (["None"],)]) == [False, True]


def test_robots_rules(values):
    rules = "array(named_struct('pattern','/a','allow',false), named_struct('pattern','/a/b','allow',true), named_struct('pattern','/*.php$','allow',false))"
    got = values(lambda p: robots.allowed_by(p, F.expr(rules)), "p string", ["/", "/a", "/a/b/c", "/x.php", "/x.php5"])
    assert got == [True, False, True, False, True]


def test_settings_are_checked():
    with pytest.raises(ValueError):
        GapSettings(keywords=0)
    with pytest.raises(ValueError):
        GapSettings(depth=0)
    with pytest.raises(ValueError):
        SnapshotSettings(position_groups=((1, 5), (4, 10)))


def test_question_words_that_end_at_letters_beyond_ascii(values):
    rows = ["doñez y", "do ñ", "document", "a vs b", "évs b", "what", "vs_x"]
    assert values(text.is_question, "t string", rows) == [False, True, False, True, False, True, False]
    loose = values(lambda t: text.is_question(t, ascii_words=True), "t string", rows)
    assert loose == [True, True, False, True, True, True, False]
    uses = values(lambda t: text.phrase_count(t, F.lit("the"), ascii_words=True), "t string", ["theé the éthe then the_"])
    assert uses == [3]


def test_pixel_width_of_every_known_and_some_other_characters(values):
    from rankloom import fixed_values as fv

    texts = [*fv.CHAR_WIDTHS, "\x01", "~", "\x7f", "\x80", "ñ", "Ж", "⺀", "漢", "😀"]
    width = lambda c: fv.CHAR_WIDTHS.get(c, fv.WIDE_CHAR_WIDTH if ord(c) >= fv.WIDE_CHAR_FROM else fv.DEFAULT_CHAR_WIDTH)
    want = [-(-20 * 7 * width(c) // 1000) for c in texts]
    assert values(snippet.pixel_width, "t string", [c * 7 for c in texts]) == want


def test_titles_of_one_file_are_checked_by_every_core(spark):
    from rankloom.workload import feed_queries

    titles = feed_queries._titles(spark, "/root/testdata/sf0.001")
    assert titles.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism

"""Search-snippet columns: rendered title width and the title/description checks."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom import fixed_values as fv
from rankloom.functions.binding import bind
from rankloom.functions.text import squeeze
from rankloom.settings import Thresholds


def pixel_width(text: Column, font_px: int = 20) -> Column:
    """Arial width in pixels, rounded up, with exact integer arithmetic."""
    # ASCII by position: a map is searched from its start for every character
    table = F.array(*[F.lit(fv.CHAR_WIDTHS.get(chr(c), fv.DEFAULT_CHAR_WIDTH)) for c in range(128)])
    others = {c: w for c, w in fv.CHAR_WIDTHS.items() if ord(c) >= 128}
    rest = F.create_map(*[F.lit(x) for x in chain(*others.items())])

    def width(ch: Column) -> Column:
        wide = F.when(F.ascii(ch) >= fv.WIDE_CHAR_FROM, fv.WIDE_CHAR_WIDTH)
        beyond = F.coalesce(F.try_element_at(rest, ch), wide, F.lit(fv.DEFAULT_CHAR_WIDTH))
        return F.when(F.ascii(ch) < 128, F.element_at(table, F.ascii(ch) + 1)).otherwise(beyond)

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    units = F.aggregate(chars, F.lit(0), lambda acc, c: acc + width(c))
    return F.floor((units * font_px + 999) / 1000).cast("int")


def snippet_check(
    title: Column, description: Column, phrase: Column | None, t: Thresholds
) -> Column:
    """struct of sizes, flags and the reasons a title or description is not right."""
    texts = F.struct(
        squeeze(F.coalesce(title, F.lit(""))).alias("title"),
        squeeze(F.coalesce(description, F.lit(""))).alias("description"),
    )
    measured = bind(
        texts,
        lambda x: F.struct(
            x["title"].alias("title"),
            x["description"].alias("description"),
            pixel_width(x["title"], t.title_font).alias("px"),
        ),
    )
    return bind(measured, lambda x: _judged(x["title"], x["description"], x["px"], phrase, t))


def _judged(title: Column, description: Column, px: Column, phrase: Column | None, t: Thresholds) -> Column:
    chars, d_chars = F.length(title), F.length(description)
    phrase = F.lit(None).cast("string") if phrase is None else F.nullif(phrase, F.lit(""))
    low = F.lower(phrase)
    in_title = F.contains(F.lower(title), low)
    first = F.startswith(F.lower(title), low)
    payoff = F.contains(F.lower(F.substring(description, 1, t.description_payoff)), low)
    quoted = F.concat(F.lit("phrase '"), phrase, F.lit("'"))

    def note(when: Column, *parts) -> Column:
        cells = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
        return F.when(when, F.concat(*[c.cast("string") for c in cells]))

    reasons = F.array_compact(
        F.array(
            note(
                px > t.title_px,
                "title is ", px, f"px, over {t.title_px}px; Google will truncate it",
            ),
            note(
                chars < t.title_chars,
                "title is ", chars, f" chars, under {t.title_chars}; room left unused",
            ),
            note(
                d_chars > t.description_max,
                "description is ", d_chars, f" chars, over {t.description_max}",
            ),
            note(
                d_chars < t.description_min,
                "description is ", d_chars, f" chars, under {t.description_min}",
            ),
            note(~in_title, quoted, " not in title"),
            note(in_title & ~first, quoted, " is not at the start of the title"),
            note(
                ~payoff, quoted, f" not in first {t.description_payoff} chars of description"
            ),
        )
    )
    title_ok = (chars >= t.title_chars) & (px <= t.title_px)
    description_ok = d_chars.between(t.description_min, t.description_max)
    return F.struct(
        title.alias("title"),
        px.alias("title_px"),
        chars.alias("title_chars"),
        d_chars.alias("description_chars"),
        title_ok.alias("title_ok"),
        description_ok.alias("description_ok"),
        in_title.alias("phrase_in_title"),
        first.alias("phrase_first_in_title"),
        payoff.alias("phrase_in_payoff"),
        (title_ok & description_ok & F.coalesce(in_title, F.lit(True))).alias("passed"),
        reasons.alias("reasons"),
    )

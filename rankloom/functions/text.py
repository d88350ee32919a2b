"""Phrase and text columns, all built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom import fixed_values as fv
from rankloom.functions.binding import bind

_SPACE = r"(?U)\s+"
_STOP = fv.STOPWORDS


def squeeze(text: Column) -> Column:
    """Single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def normalise_phrase(text: Column) -> Column:
    return squeeze(F.lower(text))


def split_words(text: Column) -> Column:
    """Whitespace words; an empty text has none."""
    return F.filter(F.split(squeeze(text), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(split_words(text))


def words(text: Column) -> Column:
    """Search words: lower-case ASCII tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(fv.WORD_PATTERN), F.lit(0))


def stem(word: Column) -> Column:
    """A plural "s" comes off words longer than three letters."""
    plural = F.endswith(word, F.lit("s")) & (F.length(word) > 3)
    shorter = F.substring(word, F.lit(1), F.length(word) - 1)
    return F.when(plural, shorter).otherwise(word)


def content_words(text: Column) -> Column:
    """Stemmed search words that are not stopwords, in text order, repeats kept."""
    return F.transform(F.filter(words(text), lambda w: ~w.isin(_STOP)), stem)


def variant_key(phrase: Column) -> Column:
    """Word order, plurals and stopwords do not matter; the phrase itself if nothing is left."""
    key = F.array_join(F.array_sort(content_words(phrase)), " ")
    return F.coalesce(F.nullif(key, F.lit("")), phrase)


def clean_phrase(text: Column, max_words: int = 7, max_chars: int = 80) -> Column:
    """A searchable lower-case phrase, or null for URLs, markup, numbers, overlong and
    navigational phrases."""
    def judge(x: Column) -> Column:
        low, phrase = x["low"], x["phrase"]
        bad = F.lit(False)
        for part in ("http", "www.", "@", "<", ">"):
            bad = bad | F.contains(low, F.lit(part))
        keep = (
            ~bad
            & (phrase != "")
            & (word_count(phrase) <= max_words)
            & (F.length(phrase) <= max_chars)
            & ~F.replace(phrase, F.lit(" "), F.lit("")).rlike(r"(?U)^\d+$")
            & ~phrase.rlike("(?U)" + fv.NAVIGATIONAL)
        )
        return F.when(keep, phrase)

    spaced = squeeze(F.regexp_replace(F.lower(text), "(?U)" + fv.NOT_PHRASE_CHAR, " "))
    phrase = F.regexp_replace(F.regexp_replace(spaced, r"^[ .'-]+", ""), r"[ .'-]+$", "")
    return bind(F.struct(F.lower(text).alias("low"), phrase.alias("phrase")), judge)


def regex_literal(text: Column) -> Column:
    """The text as a pattern that matches itself."""
    return F.regexp_replace(text, r"([\\.^$|?*+()\[\]{}-])", r"\\$1")


def contains_brand(phrase: Column, token: Column) -> Column:
    """The token as a word of the phrase (optional plural s); longer tokens also match with
    spaces ignored."""
    tight = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    pattern = F.concat(
        F.lit("(?<![a-z0-9])"), regex_literal(token), F.lit("s?(?![a-z0-9])")
    )
    as_word = F.when(F.contains(phrase, token), F.regexp_like(phrase, pattern)).otherwise(False)
    return as_word | ((F.length(token) >= 5) & F.contains(tight(phrase), tight(token)))


def cut_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(split_words(text), 1, n), " ")


def lines_of(text: Column) -> Column:
    return F.split(text, r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]")


def truncate_words(text: Column, n: int) -> Column:
    """The first n words, with line breaks kept."""
    start = F.struct(
        F.array().cast("array<string>").alias("kept"), F.lit(n).cast("int").alias("left")
    )

    def take(acc: Column, tokens: Column) -> Column:
        room = acc["left"] > 0
        piece = F.array_join(F.slice(tokens, F.lit(1), F.greatest(acc["left"], F.lit(0))), " ")
        return F.struct(
            F.when(room, F.array_append(acc["kept"], piece)).otherwise(acc["kept"]).alias("kept"),
            F.when(room, acc["left"] - F.size(tokens)).otherwise(acc["left"]).alias("left"),
        )

    def step(acc: Column, line: Column) -> Column:
        return bind(split_words(line), lambda tokens: take(acc, tokens))

    return F.aggregate(lines_of(text), start, step, lambda acc: F.array_join(acc["kept"], "\n"))


def _edges(ascii_words: bool) -> str:
    """Which letters \\b counts as parts of a word: all, or only those of ASCII (Java's own \\b, without
    the flag, counts some letters beyond)."""
    return r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))" if ascii_words else r"\b"


def phrase_count(text: Column, phrase: Column, ascii_words: bool = False) -> Column:
    """Whole-word uses of the phrase."""
    edge = F.lit("(?U)" + _edges(ascii_words))
    pattern = F.concat(edge, regex_literal(F.lower(phrase)), F.lit(_edges(ascii_words)))
    return F.size(F.regexp_extract_all(F.lower(text), pattern, F.lit(0)))


def phrase_density(text: Column, phrase: Column) -> Column:
    """Uses per 100 words, counting every word of the phrase."""
    uses = phrase_count(text, phrase) * word_count(phrase)
    return F.lit(100.0) * uses / F.greatest(word_count(text), F.lit(1))


def placeholders(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(fv.PLACEHOLDER), F.lit(0)))


def is_question(text: Column, ascii_words: bool = False) -> Column:
    """Starts with a question word or holds "vs". With `ascii_words` a letter beyond ASCII ends a word, as
    in SQL engines whose \\b knows ASCII only: then "doñez" starts with "do"."""
    return text.rlike("(?U)" + fv.QUESTION.replace(r"\b", _edges(ascii_words)))


def newest_year(title: Column) -> Column:
    years = F.regexp_extract_all(title, F.lit("(?U)" + fv.TITLE_YEAR), F.lit(1))
    return F.array_max(F.transform(years, lambda y: y.cast("int")))


def in_autocomplete(phrase: Column, suggestions: Column) -> Column:
    """Suggested as itself or as the start of a longer search; null when the list is null."""
    longer = F.concat(phrase, F.lit(" "))
    return F.exists(suggestions, lambda s: (s == phrase) | F.startswith(s, longer))


def sentence_grams(text: Column, low: int = 2, high: int = 4) -> Column:
    """All word n-grams inside sentences, without stopword edges or all-digit words. Each word is
    judged once; grams are then read off the flags."""

    def flagged(sentence: Column) -> Column:
        tokens = F.regexp_extract_all(sentence, F.lit(fv.WORD_PATTERN), F.lit(0))
        return F.transform(
            tokens,
            lambda t: F.struct(
                t.alias("w"),
                (~t.isin(_STOP) & ~t.rlike(r"^\d+$")).alias("edge"),
                t.rlike(r"^\d+$").alias("digits"),
            ),
        )

    def sized(tokens: Column, starts: Column, n: int) -> Column:
        def fits(i: Column) -> Column:
            ok = (i + (n - 1) <= F.size(tokens)) & F.try_element_at(tokens, i + (n - 1))["edge"]
            for k in range(1, n - 1):
                ok = ok & ~F.try_element_at(tokens, i + k)["digits"]
            return ok

        def gram(i: Column) -> Column:
            return F.concat_ws(" ", *[F.element_at(tokens, i + k)["w"] for k in range(n)])

        return F.transform(F.filter(starts, fits), gram)

    def grams(tokens: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))),
            lambda i: F.coalesce(F.try_element_at(tokens, i)["edge"], F.lit(False)),
        )
        return bind(
            starts,
            lambda st: F.concat(*[sized(tokens, st, n) for n in range(low, high + 1)]),
        )

    sentences = F.transform(F.split(F.lower(text), fv.SENTENCE_BREAK), flagged)
    return F.flatten(F.transform(sentences, grams))


def passages(text: Column, max_words: int = 120) -> Column:
    """Paragraphs packed into passages of at most max_words words; longer ones are split."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), empty.alias("open"))

    def step(acc: Column, paragraph: Column) -> Column:
        return bind(split_words(paragraph), lambda w: pack(acc, w))

    def pack(acc: Column, w: Column) -> Column:
        size = F.size(w)
        flush = (
            (size > 0) & (F.size(acc["open"]) > 0) & (F.size(acc["open"]) + size > max_words)
        )
        full = F.greatest(F.floor((size - 1) / max_words).cast("int"), F.lit(0))
        full = F.when(size > max_words, full).otherwise(0)
        whole = F.when(
            full > 0,
            F.transform(
                F.sequence(F.lit(0), full - 1),
                lambda i: F.array_join(F.slice(w, i * max_words + 1, max_words), " "),
            ),
        ).otherwise(empty)
        closed = F.when(flush, F.array(F.array_join(acc["open"], " "))).otherwise(empty)
        kept = F.when(flush, empty).otherwise(acc["open"])
        rest = F.slice(w, full * max_words + 1, max_words)
        return F.struct(
            F.concat(acc["done"], closed, whole).alias("done"),
            F.concat(kept, rest).alias("open"),
        )

    def finish(acc: Column) -> Column:
        last = F.when(
            F.size(acc["open"]) > 0, F.array(F.array_join(acc["open"], " "))
        ).otherwise(empty)
        return F.concat(acc["done"], last)

    return F.aggregate(F.split(text, r"\n"), start, step, finish)

"""Checks of a written brief and draft: counts only, no writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rankloom.functions.numeric import fixed_text
from rankloom.functions.snippet import snippet_check
from rankloom.functions.text import (
    cut_words,
    phrase_count,
    phrase_density,
    placeholders,
    word_count,
)
from rankloom.settings import Thresholds


def target_length(pages: DataFrame, t: Thresholds) -> DataFrame:
    """Words to aim for per run: the upper median of competitor lengths, kept in range. pages:
    run_id, words. The discrete upper median is an exact aggregate, so nothing is collected."""
    n = F.count("*")
    middle = F.floor(n / 2) + 1
    counted = pages.groupBy("run_id", "words").agg(F.count("*").alias("n"))
    order = W.partitionBy("run_id").orderBy("words")
    totals = pages.groupBy("run_id").agg(middle.alias("middle"))
    running = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        counted.withColumn("running", running)
        .join(totals, "run_id")
        .filter(F.col("running") >= F.col("middle"))
        .groupBy("run_id")
        .agg(F.min("words").alias("median"))
        .select(
            "run_id",
            "median",
            F.least(
                F.lit(t.draft_max_words), F.greatest(F.lit(t.draft_min_words), F.col("median"))
            ).alias("target_words"),
        )
    )


def draft_text() -> Column:
    """The whole draft, one part per line, empty parts left out."""
    sections = F.flatten(
        F.transform("sections", lambda x: F.array(x["heading"], x["body"]))
    )
    faq = F.flatten(F.transform("faq", lambda x: F.array(x["question"], x["answer"])))
    parts = F.concat(F.array("h1", "intro"), sections, faq, F.array("cta"))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n")


def draft_checks(drafts: DataFrame, t: Thresholds) -> DataFrame:
    """(run_id, label, ok, detail) per draft. drafts: run_id, phrase, h1, intro, sections
    array<struct<heading, body>>, faq array<struct<question, answer>>, cta."""
    low = F.lower("phrase")
    text = F.col("text")
    n, sections, questions = word_count(text), F.size("sections"), F.size("faq")
    uses, density = phrase_count(text, F.col("phrase")), phrase_density(text, F.col("phrase"))
    opening = F.lower(cut_words(F.concat_ws(" ", "h1", "intro"), 100))
    todo = placeholders(text)

    def check(label: str, ok: Column, *detail) -> Column:
        cells = [d.cast("string") if isinstance(d, Column) else F.lit(str(d)) for d in detail]
        return F.struct(
            F.lit(label).alias("label"),
            ok.alias("ok"),
            (F.concat(*cells) if cells else F.lit("")).alias("detail"),
        )

    marked = F.when(
        F.size(todo) > 0,
        F.concat(F.size(todo).cast("string"), F.lit(" placeholder(s) marked [ADD: …]")),
    ).otherwise("none")
    checks = [
        check("Main search phrase in the H1", F.contains(F.lower("h1"), low)),
        check("Main phrase in the first 100 words", F.contains(opening, low)),
        check(
            "No keyword stuffing", density <= t.draft_density,
            "phrase used ", uses, "× (", fixed_text(density, 1), " per 100 words)",
        ),
        check(
            "Right length to compete",
            n.between(t.draft_min_words, t.draft_max_words * 1.2),
            n, f" words (aim for {t.draft_min_words} to {t.draft_max_words})",
        ),
        check("Clear section structure", sections.between(3, 8), sections, " sections"),
        check("FAQ answers searcher questions", questions >= 3, questions, " questions"),
        check("Facts to fill in", F.size(todo) == 0, marked),
    ]
    return drafts.withColumn("text", draft_text()).select("run_id", F.inline(F.array(*checks)))


def title_choices(titles: DataFrame, t: Thresholds, keep: int = 3) -> DataFrame:
    """Suggested titles with their snippet check, passing ones first, at most `keep` per run.
    titles: run_id, pos, title, description, phrase."""
    checked = titles.withColumn(
        "check",
        snippet_check(F.col("title"), F.col("description"), F.col("phrase"), t),
    )
    order = W.partitionBy("run_id").orderBy((~F.col("check.passed")).cast("int"), "pos")
    return checked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)


CHECKLIST = [
    "phrase_in_title", "phrase_first_in_title", "title_width_ok", "description_length_ok",
    "phrase_in_description_payoff", "phrase_in_h1", "intent_matches", "no_stuffing",
]


def brief_checklist(best: DataFrame) -> DataFrame:
    """Eight yes/no answers and how many are yes. best: run_id, check (of the best title), phrase,
    first_heading, intent_flag, stuffing_warnings."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    check = F.col("check")
    answers = [
        yes(check["phrase_in_title"]),
        yes(check["phrase_first_in_title"]),
        check["title_ok"],
        check["description_ok"],
        yes(check["phrase_in_payoff"]),
        F.contains(F.lower(F.coalesce("first_heading", F.lit(""))), F.lower("phrase")),
        F.col("intent_flag").isNull(),
        F.coalesce("stuffing_warnings", F.lit(0)) == 0,
    ]
    named = [a.alias(n) for a, n in zip(answers, CHECKLIST, strict=True)]
    passed = sum((a.cast("int") for a in answers[1:]), answers[0].cast("int"))
    return best.select("run_id", *named, passed.alias("passed"))

"""Topic coverage: merged topics, passage labels, counts, score, stuffing, gaps and evidence.

Pages are (run_id, page, ours, text[, domain]); topics (run_id, page, topic); evidence
(run_id, ord, text, source).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rankloom import fixed_values as fv
from rankloom.functions.numeric import bucket_for, fixed_text, ordered_sum, saturation
from rankloom.functions.text import content_words, normalise_phrase, regex_literal
from rankloom.operators.clusters import best_match_above, greedy_vector_heads
from rankloom.operators.phrases import Embedder, hashed_embedder
from rankloom.session import cut_lineage
from rankloom.settings import Thresholds, within


def evidence_union(rows: DataFrame) -> DataFrame:
    """(run_id, text, source, prio, ord) -> distinct evidence by normalised text, first wins:
    page questions, then suggested questions, then related searches, then cluster phrases."""
    keyed = rows.withColumn("key", normalise_phrase(F.col("text"))).filter("key <> ''")
    return (
        keyed.groupBy("run_id", "key")
        .agg(F.min(F.struct("prio", "ord", "source", "text")).alias("e"))
        .select(
            "run_id",
            F.struct("e.prio", "e.ord").alias("ord"),
            F.col("e.text").alias("text"),
            F.col("e.source").alias("source"),
        )
    )


def topic_labels(topics: DataFrame) -> DataFrame:
    """(run_id, page, label) distinct normalised topic labels of competitor pages."""
    label = normalise_phrase(F.col("topic"))
    return topics.select("run_id", "page", label.alias("label")).filter("label <> ''").distinct()


def merge_topics(
    topics: DataFrame, t: Thresholds, embed: Embedder = hashed_embedder
) -> DataFrame:
    """(run_id, label, topic): every label with the leading label of its group. Labels listed by
    more pages lead, then shorter ones."""
    labels = topic_labels(topics)
    counted = labels.groupBy("run_id", "label").agg(F.count("*").alias("pages"))
    items = embed(counted, "label", "vector").select(
        "run_id",
        F.col("label").alias("item"),
        F.struct(
            (-F.col("pages")).alias("pages"), F.length("label").alias("length"), "label"
        ).alias("order"),
        "vector",
    )
    heads = greedy_vector_heads(items, t.topic_similarity)
    return heads.select("run_id", F.col("item").alias("label"), F.col("head").alias("topic"))


def topic_pages(topics: DataFrame, groups: DataFrame) -> DataFrame:
    """(run_id, topic, page): pages that list any label of a topic."""
    return (
        topic_labels(topics)
        .join(groups, ["run_id", "label"])
        .select("run_id", "topic", "page")
        .distinct()
    )


def labelled_topics(listed: DataFrame, t: Thresholds) -> DataFrame:
    """Topics with their listed pages; `place` is set for those that get passage labels."""
    counts = listed.groupBy("run_id", "topic").agg(F.count("*").alias("listed"))
    order = W.partitionBy("run_id").orderBy(F.desc("listed"), "topic")
    best = (
        counts.withColumn("place", F.row_number().over(order))
        .filter(within("place", t.labelled_topics))
        .select("run_id", "topic", "place")
    )
    return counts.join(best, ["run_id", "topic"], "left")


def open_questions(
    evidence: DataFrame, labels: DataFrame, t: Thresholds, embed: Embedder = hashed_embedder
) -> DataFrame:
    """Searcher questions close to no topic label, the first few of each run. `labels` is
    (run_id, label) of all group members; a run without topics keeps all its questions."""
    asked = evidence.filter(F.col("source").isin(fv.QUESTION_SOURCES))
    near = _near(asked, labels, t, embed).select("run_id", F.col("item").alias("text"))
    order = W.partitionBy("run_id").orderBy("ord", "text")
    return (
        asked.join(near, ["run_id", "text"], "left_anti")
        .withColumn("place", F.row_number().over(order))
        .filter(within("place", t.open_questions))
        .select("run_id", "text", "source", "place")
    )


def _near(evidence: DataFrame, labels: DataFrame, t: Thresholds, embed: Embedder) -> DataFrame:
    """Evidence close to a label, with the closest one."""
    left = embed(evidence.select("run_id", F.col("text").alias("item")).distinct(), "item", "vector")
    right = embed(labels.select("run_id", F.col("label").alias("item")).distinct(), "item", "vector")
    right = right.withColumn("order", F.xxhash64("item"))
    return best_match_above(left, right, t.evidence_similarity)


HEAVY_KEYS = 1000  # a key is heavy if it holds more than this part of all rows: so many at most


def heavy_keys(counts: DataFrame, keys: list[str], parts: int = HEAVY_KEYS) -> DataFrame:
    """Keys that hold more than 1/parts of all rows, with `salts`, the pieces to cut each into. counts:
    keys and n. There can't be more than `parts` of them, which bounds what is broadcast."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") * parts > total).select(
        *keys, F.ceil(F.col("n") * parts / F.lit(max(total, 1))).alias("salts")
    )


def split_join(rows: DataFrame, few: DataFrame, keys: list[str], heavy: DataFrame, spread: list[str]) -> DataFrame:
    """rows inner join few on `keys`, with heavy keys cut up: a heavy key's rows are salted by `spread`
    and its rows of `few` are repeated for every salt."""
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    salted = rows.join(F.broadcast(heavy), keys, "left").withColumn(
        "salt", F.pmod(F.xxhash64(*spread), salts)
    )
    copies = few.join(F.broadcast(heavy), keys, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))
    )
    return salted.drop("salts").join(copies.drop("salts"), [*keys, "salt"]).drop("salt")


PASSAGE_BLOCK = 16_384
LABEL_BLOCK = 131_072


def passage_hits(
    passages: DataFrame, wanted: DataFrame, passage_block: int = PASSAGE_BLOCK, label_block: int = LABEL_BLOCK
) -> DataFrame:
    """Default labeller: a passage discusses a label when it holds all its content words.

    passages: run_id, page, passage_no, passage; wanted: run_id, label. The passages and the labels of
    a run are dealt into blocks of about a given size, and a task gets one block of either: a passage's
    words go out once per block of labels, a label once per block of passages, and candidates never
    leave their task (see `_hits_of_blocks`).
    """
    held = held_words(passages.select("run_id", "page", "passage_no", "passage"))
    schema = held.select("run_id", "page", "passage_no").schema.add("label", "string")
    dealt = _dealt(held, cut_lineage(needed_words(wanted)), passage_block, label_block, ["page", "passage_no"])
    return dealt.applyInArrow(_hits_of_blocks, schema)


def held_words(passages: DataFrame) -> DataFrame:
    """Passages that have a text, written out with its distinct content words in its place."""
    words = F.array_distinct(content_words(F.col("passage")))
    return cut_lineage(passages.filter(F.col("passage").isNotNull()).withColumn("words", words).drop("passage"))


def needed_words(wanted: DataFrame) -> DataFrame:
    """(run_id, label, words): the distinct labels that have content words."""
    words = F.array_distinct(content_words(F.col("label")))
    return wanted.select("run_id", "label").distinct().withColumn("words", words).filter(F.size("words") > 0)


def _dealt(
    held: DataFrame, need: DataFrame, passage_block: int, label_block: int, by: list[str], listed: DataFrame | None = None
):
    """Blocks of passages cogrouped with blocks of labels, every one of a run with every one: passages
    that share `by` are in one block. Rows of `listed` go where the passages of their page go."""

    def blocks(rows: DataFrame, name: str, size: int) -> DataFrame:
        return rows.groupBy("run_id").agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    # written out, so that Spark knows how small it is and passages aren't shuffled to meet it
    grid = cut_lineage(blocks(held, "ps", passage_block).join(blocks(need, "ls", label_block), "run_id"))
    keys = ["run_id", "p", "l"]
    every = {n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)) for n in ("ps", "ls")}
    own = {
        "ps": F.pmod(F.xxhash64(*by), F.col("ps")).cast("int"),
        "ls": F.pmod(F.xxhash64("label"), F.col("ls")).cast("int"),
    }
    said = held if listed is None else held.unionByName(listed, allowMissingColumns=True)
    left = said.join(grid, "run_id").select(*said.columns, own["ps"].alias("p"), every["ls"].alias("l"))
    right = need.join(grid, "run_id").select("run_id", "label", "words", every["ps"].alias("p"), own["ls"].alias("l"))
    # a given number, as few bytes make much work here and would be put into few tasks
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = (rows.repartition(parts, *keys).groupBy(*keys) for rows in (left, right))
    return next(sides).cogroup(next(sides))


def _hits_of_blocks(passages: pa.Table, labels: pa.Table) -> pa.Table:
    """The hits among some passages and some labels."""
    at, row = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for label, found in _passages_of_labels(passages, labels):
        at.append(np.full(len(found), label))
        row.append(found)
    place = passages.select(["run_id", "page", "passage_no"]).take(pa.array(np.concatenate(row)))
    return place.append_column("label", labels.column("label").take(pa.array(np.concatenate(at))))


TOTALS_PASSAGE_BLOCK = 131_072
TOTALS_LABEL_BLOCK = 524_288


def label_totals(
    held: DataFrame,
    wanted: DataFrame,
    listed: DataFrame,
    passage_block: int = TOTALS_PASSAGE_BLOCK,
    label_block: int = TOTALS_LABEL_BLOCK,
) -> DataFrame:
    """(run_id, label, pages, both, ours_passages): what `page_totals` says of `passage_hits`, counted where a
    block of labels meets a block of whole pages, so that hits, of which there are many more than pages
    and labels, are never rows. held: of `held_words`, with ours; listed: run_id, topic, page."""
    lists = listed.select("run_id", "page", F.array("topic").alias("words"))
    dealt = _dealt(_judged(held), cut_lineage(needed_words(wanted)), passage_block, label_block, ["page"], lists)
    counts, schema = ("pages", "both", "ours_passages"), held.select("run_id").schema.add("label", "string")
    for name in counts:
        schema = schema.add(name, "long")
    parts = dealt.applyInArrow(_totals_of_blocks, schema)
    return parts.groupBy("run_id", "label").agg(*[F.sum(name).alias(name) for name in counts])


def label_pages(
    held: DataFrame, wanted: DataFrame, passage_block: int = TOTALS_PASSAGE_BLOCK, label_block: int = TOTALS_LABEL_BLOCK
) -> DataFrame:
    """(run_id, label, page, ours, n): `page_counts` of `passage_hits`, counted like `label_totals`. For a few
    labels: those of all topics are about as many rows as hits."""
    schema = held.select("run_id", "page", "ours").schema.add("label", "string").add("n", "long")
    dealt = _dealt(_judged(held), needed_words(wanted), passage_block, label_block, ["page"])
    return dealt.applyInArrow(_pages_of_blocks, schema).select("run_id", "label", "page", "ours", "n")


def _judged(held: DataFrame) -> DataFrame:
    known = F.col("page").isNotNull() & F.col("ours").isNotNull()
    return held.select("run_id", "page", "ours", "passage_no", "words").filter(known)


def _by_page(passages: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The passages in the order of their pages, the number of the page of each, and the first passage of each page."""
    page = passages.column("page").combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.argsort(page, kind="stable")
    page = page[order]
    return passages.take(pa.array(order)), page, np.flatnonzero(np.diff(page, prepend=-1))


def _passages_of_labels(passages: pa.Table, labels: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(label, passages that hold all its words, ascending) by row numbers, for labels that have any: the
    holders of its rarest word among those of its commonest word, which are marked once for all labels
    that share it, and of the words between."""
    held, need = passages.column("words").combine_chunks(), labels.column("words").combine_chunks()
    known = need.flatten().unique()
    code = pc.fill_null(pc.index_in(held.flatten(), known), -1).to_numpy()
    row = np.repeat(np.arange(len(held)), pc.fill_null(pc.list_value_length(held), 0).to_numpy())
    row, code = row[code >= 0], code[code >= 0]
    row = row[np.argsort(code, kind="stable")]
    common = np.bincount(code, minlength=len(known))
    start = np.concatenate([[0], np.cumsum(common)])
    holders = [row[a:b] for a, b in zip(start[:-1], start[1:], strict=True)]

    words = pc.index_in(need.flatten(), known).to_numpy()
    size = pc.list_value_length(need).to_numpy()
    label = np.repeat(np.arange(len(need)), size)
    words = words[np.lexsort((words, common[words], label))]  # of each label the rarest first
    end = np.cumsum(size)
    found_all = common[words[end - size]] > 0
    by_commonest = np.argsort(words[end - 1], kind="stable")
    words, first, last = words.tolist(), (end - size).tolist(), (end - 1).tolist()
    inside, marked = np.zeros(len(held), bool), -1
    for at in by_commonest[found_all[by_commonest]].tolist():
        top = words[last[at]]
        if top != marked:
            if marked >= 0:
                inside[holders[marked]] = False
            inside[holders[top]] = True
            marked = top
        found = holders[words[first[at]]]
        if first[at] < last[at]:
            found = found[inside[found]]
        for word in words[first[at] + 1 : last[at]]:
            others = holders[word]
            found = found[others.take(np.searchsorted(others, found), mode="clip") == found]
        if len(found):
            yield at, found


def _totals_of_blocks(passages: pa.Table, labels: pa.Table) -> pa.Table:
    """Per label of a block: the competitor pages of a block that discuss it, those of them that list it, our
    passages. Rows without a passage number list the label in their words."""
    listing = passages.column("passage_no").is_null()
    said, lists = passages.filter(pc.invert(listing)), passages.filter(listing)
    said, page, first = _by_page(said)
    rival = ~said.column("ours").combine_chunks().to_numpy(zero_copy_only=False)
    rivals = rival[first]  # by page
    names = said.column("page").combine_chunks().take(pa.array(first))
    listed = lists.column("words").combine_chunks().flatten()
    by = pc.fill_null(pc.index_in(listed, labels.column("label").combine_chunks()), -1).to_numpy()
    on = pc.fill_null(pc.index_in(lists.column("page").combine_chunks(), names), -1).to_numpy()
    by, on = by[on >= 0], on[on >= 0]
    order = np.argsort(by, kind="stable")
    on, start = on[order], np.searchsorted(by[order], np.arange(labels.num_rows + 1)).tolist()
    rows: list[tuple[int, int, int, int]] = []
    for at, found in _passages_of_labels(said, labels):
        pages = page[found]
        theirs = rival[found]
        mine = len(found) - int(np.count_nonzero(theirs))
        pages = pages if not mine else pages[theirs]
        pages = pages[np.flatnonzero(np.diff(pages, prepend=-1))]
        both = 0
        if start[at] < start[at + 1] and len(pages):
            there = on[start[at] : start[at + 1]]
            both = int(np.count_nonzero(pages.take(np.searchsorted(pages, there), mode="clip") == there))
        rows.append((at, len(pages), both, mine))
    at, *counts = np.array(rows, np.int64).reshape(-1, 4).T
    found = labels.select(["run_id", "label"]).take(pa.array(at))
    for name, n in zip(("pages", "both", "ours_passages"), counts, strict=True):
        found = found.append_column(name, pa.array(n))
    return found


def _pages_of_blocks(passages: pa.Table, labels: pa.Table) -> pa.Table:
    """Per label and page of a block: the passages that discuss it."""
    said, page, _ = _by_page(passages)
    at, row, n = ([np.empty(0, np.int64)] for _ in range(3))
    for label, found in _passages_of_labels(said, labels):
        first = np.flatnonzero(np.diff(page[found], prepend=-1))
        at.append(np.full(len(first), label))
        row.append(found[first])
        n.append(np.diff(first, append=len(found)))
    rows = said.select(["run_id", "page", "ours"]).take(pa.array(np.concatenate(row)))
    rows = rows.append_column("label", labels.column("label").take(pa.array(np.concatenate(at))))
    return rows.append_column("n", pa.array(np.concatenate(n)))


def landed_hits(labels: DataFrame, passages: DataFrame) -> DataFrame:
    """Labels judged elsewhere (run_id, page, label, passage_no); unknown passages are dropped."""
    known = passages.select("run_id", "page", "passage_no")
    return labels.distinct().join(known, ["run_id", "page", "passage_no"], "left_semi")


def page_counts(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """(run_id, label, page, ours, n): passages of each page that discuss a label."""
    counts = hits.groupBy("run_id", "label", "page").agg(F.count("*").alias("n"))
    return counts.join(pages.select("run_id", "page", "ours"), ["run_id", "page"])


def page_totals(per_page: DataFrame, listed: DataFrame) -> DataFrame:
    """(run_id, label, pages, both, ours_passages): competitor pages that discuss a label, those of them that
    list it, and our passages on it."""
    lists = listed.select("run_id", F.col("topic").alias("label"), "page", F.lit(True).alias("lists"))
    theirs = F.when(~F.col("ours"), F.col("page"))
    return (
        per_page.join(lists, ["run_id", "label", "page"], "left")
        .groupBy("run_id", "label")
        .agg(
            F.countDistinct(theirs).alias("pages"),
            F.countDistinct(F.when(F.col("lists"), theirs)).alias("both"),
            F.coalesce(F.sum(F.when(F.col("ours"), F.col("n"))), F.lit(0)).alias("ours_passages"),
        )
    )


def topic_counts(topics: DataFrame, totals: DataFrame, pages: DataFrame, t: Thresholds) -> DataFrame:
    """Per topic: competitors covering it (a passage discusses it or the page lists it), our
    passages, and the bucket. topics: of `labelled_topics`; totals: of `label_totals` or `page_totals`."""
    rivals = pages.groupBy("run_id").agg(F.count_if(~F.col("ours")).alias("total"))
    seen = totals.withColumnRenamed("label", "topic")
    known = F.col("place").isNotNull()
    more = F.when(known, F.col("pages") - F.col("both"))
    share = F.when(F.col("total") > 0, F.col("covered_by") / F.col("total")).otherwise(F.lit(0.0))
    return (
        topics.join(seen, ["run_id", "topic"], "left")
        .join(rivals, "run_id")
        .withColumns(
            {
                "covered_by": F.col("listed") + F.coalesce(more, F.lit(0)),
                "ours_passages": F.coalesce(F.when(known, F.col("ours_passages")), F.lit(0)),
            }
        )
        .withColumn("bucket", bucket_for(share, t))
        .select(
            "run_id", "topic", "listed", "place", "covered_by", "total", "ours_passages", "bucket"
        )
    )


def mark_noise(
    counts: DataFrame, brand_names: DataFrame | None, noise: DataFrame | None
) -> DataFrame:
    """Topics that hold a competitor's name (run_id, brand: at most competitors_max per run) or
    were judged noise (run_id, topic, reason) leave the buckets."""
    out = counts.withColumn("brands", F.lit(None).cast("array<string>"))
    if brand_names is not None:
        per_run = brand_names.groupBy("run_id").agg(
            F.array_sort(F.collect_set("brand")).alias("brands")
        )
        out = counts.join(per_run, "run_id", "left")

    def named(b: Column) -> Column:
        pattern = F.concat(F.lit(r"(?U)\b"), regex_literal(b), F.lit(r"\b"))
        return F.when(
            F.contains(F.col("topic"), b), F.regexp_like(F.col("topic"), pattern)
        ).otherwise(False)

    hit = F.try_element_at(F.filter("brands", named), F.lit(1))
    out = out.withColumn("hit", hit).withColumns(
        {
            "bucket": F.when(F.col("hit").isNotNull(), "noise").otherwise(F.col("bucket")),
            "noise_reason": F.when(
                F.col("hit").isNotNull(),
                F.concat(F.lit("competitor brand ("), F.col("hit"), F.lit(")")),
            ).otherwise(F.lit("")),
        }
    )
    out = out.drop("hit", "brands")
    if noise is None:
        return out
    judged = noise.select(
        "run_id", normalise_phrase(F.col("topic")).alias("topic"), F.col("reason").alias("_why")
    )
    newly = F.col("_why").isNotNull() & (F.col("bucket") != "noise")
    return (
        out.join(judged, ["run_id", "topic"], "left")
        .withColumn("noise_reason", F.when(newly, F.col("_why")).otherwise(F.col("noise_reason")))
        .withColumn("bucket", F.when(newly, "noise").otherwise(F.col("bucket")))
        .drop("_why")
    )


def content_scores(counts: DataFrame, t: Thresholds) -> DataFrame:
    """Score 0-100 per run with its arithmetic. Only topics a fair share of competitors cover
    count, so the array per run is short; it is summed in topic order to be repeatable."""
    w = F.col("covered_by") / F.col("total")
    s = saturation(F.col("ours_passages"), t.saturation_k)
    rows = counts.filter(F.col("bucket").isin("must", "worth") & (F.col("total") > 0)).select(
        "run_id",
        F.struct(
            (-F.col("listed")).alias("listed"),
            "topic",
            (w * s).alias("num"),
            (w * F.lit(t.saturation_target)).alias("den"),
            F.concat(
                F.col("covered_by").cast("string"), F.lit("/"), F.col("total").cast("string"),
                F.lit("×"), fixed_text(s, 2),
            ).alias("term"),
        ).alias("x"),
    )
    sums = rows.groupBy("run_id").agg(F.collect_list("x").alias("xs"))
    num, den = ordered_sum(F.col("xs"), "num"), ordered_sum(F.col("xs"), "den")
    terms = F.transform(F.array_sort("xs"), lambda x: x["term"])
    more = F.when(
        F.size("xs") > 12,
        F.concat(F.lit(" + … ("), (F.size("xs") - 12).cast("string"), F.lit(" more)")),
    ).otherwise(F.lit(""))
    exact = F.lit(100.0) * F.col("num") / F.col("den")
    scored = (
        sums.withColumns({"num": num, "den": den})
        .withColumn("score", F.least(F.lit(100), F.bround(exact, 0).cast("int")))
        .withColumn(
            "arithmetic",
            F.concat(
                F.lit(f"score = min(100, 100 × Σ(w×s) / Σ(w×{t.saturation_target})) = 100 × "),
                fixed_text(F.col("num"), 2), F.lit(" / "), fixed_text(F.col("den"), 2),
                F.lit(" = "), F.bround(exact, 0).cast("long").cast("string"), F.lit(" → "),
                F.col("score").cast("string"),
                F.lit("; w = share of competitors covering the topic, s = "
                      f"n/(n+{t.saturation_k}) for n passages in our page. Terms: "),
                F.array_join(F.slice(terms, 1, 12), " + "), more,
            ),
        )
        .select("run_id", "score", "arithmetic")
    )
    runs = counts.select("run_id").distinct()
    return runs.join(scored, "run_id", "left").select(
        "run_id",
        F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce("arithmetic", F.lit("no must-cover or worth-covering topics")).alias(
            "arithmetic"
        ),
    )


def stuffing_suspects(counts: DataFrame) -> DataFrame:
    """Topics of which our page may be stuffed: (run_id, topic, ours_passages, total)."""
    return counts.filter(
        F.col("bucket").isin("must", "worth") & (F.col("ours_passages") >= 2)
    ).select("run_id", "topic", "ours_passages", "total")


def stuffing(counts: DataFrame, per_page: DataFrame, t: Thresholds) -> DataFrame:
    """Topics our page repeats more than the given quantile of competitors does. per_page: of the suspects
    at least. Competitors without a passage count as zero: they enter the percentile as one weighted row."""
    suspects = stuffing_suspects(counts)
    used = (
        per_page.filter(~F.col("ours"))
        .withColumnRenamed("label", "topic")
        .join(suspects, ["run_id", "topic"], "left_semi")
        .groupBy("run_id", "topic", "n")
        .agg(F.count("*").alias("freq"))
    )
    silent = (
        suspects.join(
            used.groupBy("run_id", "topic").agg(F.sum("freq").alias("seen")),
            ["run_id", "topic"],
            "left",
        )
        .select(
            "run_id",
            "topic",
            F.lit(0).cast("long").alias("n"),
            (F.col("total") - F.coalesce("seen", F.lit(0))).alias("freq"),
        )
        .filter("freq > 0")
    )
    limits = (
        used.unionByName(silent)
        .groupBy("run_id", "topic")
        .agg(F.percentile("n", t.stuffing_quantile, F.col("freq")).alias("usual"))
    )
    return (
        suspects.join(limits, ["run_id", "topic"])
        .filter(F.col("ours_passages") > F.col("usual"))
        .select(
            "run_id",
            "topic",
            "ours_passages",
            "usual",
            F.concat(
                F.lit("'"), F.col("topic"), F.lit("' appears in "),
                F.col("ours_passages").cast("string"),
                F.lit(" passages; 90% of competitors use at most "),
                F.bround("usual", 0).cast("long").cast("string"),
            ).alias("warning"),
        )
    )


def find_gaps(
    counts: DataFrame,
    groups: DataFrame,
    evidence: DataFrame,
    questions: DataFrame,
    label_totals: DataFrame,
    pages: DataFrame,
    t: Thresholds,
    embed: Embedder = hashed_embedder,
) -> DataFrame:
    """Gaps per run: rare topics we lack that searchers ask about, then open questions few pages
    answer."""
    rare = counts.filter((F.col("bucket") == "rare") & (F.col("ours_passages") == 0))
    members = groups.join(rare.select("run_id", "topic"), ["run_id", "topic"], "left_semi")
    asked = evidence.select("run_id", F.col("text").alias("item"), "ord", "source").withColumn(
        "place",
        F.struct("ord", "item"),
    )
    left = embed(members.select("run_id", F.col("label").alias("item")).distinct(), "item", "vector")
    right = embed(asked, "item", "vector").withColumn("order", evidence_rank(F.col("ord")))
    near = best_match_above(left, right, t.evidence_similarity)
    best = (
        near.withColumnRenamed("item", "label")
        .join(members, ["run_id", "label"])
        .join(
            asked.select("run_id", F.col("item").alias("match"), "ord", "source"),
            ["run_id", "match"],
        )
        .groupBy("run_id", "topic")
        .agg(
            F.max_by(
                F.struct("match", "source"),
                F.struct("similarity", (-evidence_rank(F.col("ord"))).alias("o")),
            ).alias("e")
        )
    )
    topic_gaps = rare.join(best, ["run_id", "topic"]).select(
        "run_id",
        "topic",
        "covered_by",
        F.concat("e.source", F.lit(": "), "e.match").alias("evidence"),
        F.struct(
            F.lit(0).alias("kind"), (-F.col("listed")).alias("n"), F.col("topic").alias("text")
        ).alias("place"),
    )
    answers = label_totals.select(
        "run_id", "label", F.col("pages").alias("covered_by"), (F.col("ours_passages") > 0).alias("ours")
    )
    totals = pages.groupBy("run_id").agg(F.count_if(~F.col("ours")).alias("total"))
    few = (F.col("total") == 0) | (F.col("covered_by") / F.col("total") < t.worth_share)
    question_gaps = (
        questions.join(answers.withColumnRenamed("label", "text"), ["run_id", "text"], "left")
        .withColumns(
            {
                "covered_by": F.coalesce("covered_by", F.lit(0)),
                "ours": F.coalesce("ours", F.lit(False)),
            }
        )
        .join(totals, "run_id")
        .filter(~F.col("ours") & few)
        .select(
            "run_id",
            F.col("text").alias("topic"),
            "covered_by",
            F.concat("source", F.lit(": "), "text").alias("evidence"),
            F.struct(
                F.lit(1).alias("kind"), F.col("place").cast("long").alias("n"), "text"
            ).alias("place"),
        )
    )
    order = W.partitionBy("run_id").orderBy("place")
    return (
        topic_gaps.unionByName(question_gaps)
        .withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= t.max_gaps)
        .drop("place")
    )


def evidence_rank(ord_):
    """A sortable number of an evidence place (source priority, then order within it)."""
    return ord_["prio"].cast("long") * F.lit(1 << 48) + ord_["ord"].cast("long")


def key_topics(counts: DataFrame) -> DataFrame:
    """Per run: how many key topics our page covers, out of how many."""
    key = F.col("bucket").isin("must", "worth")
    return counts.groupBy("run_id").agg(
        F.count_if(key & (F.col("ours_passages") > 0)).alias("covered"),
        F.count_if(key).alias("total"),
    )


def listing_order() -> list:
    """Topics to show first: bucket, missing ones, coverage, name."""
    bucket = (
        F.when(F.col("bucket") == "must", 0)
        .when(F.col("bucket") == "worth", 1)
        .when(F.col("bucket") == "rare", 2)
        .otherwise(3)
    )
    return [bucket, F.col("ours_passages") > 0, F.desc("covered_by"), F.col("topic").asc()]


def drop_judged(rows: DataFrame, rejected: DataFrame, keys: list[str]) -> DataFrame:
    """Rows a judge rejected go; rows nobody judged stay."""
    return rows.join(rejected.select(*keys), keys, "left_anti")

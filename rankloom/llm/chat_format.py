"""Chat formatting of reply trees, with DataFrame operations only.

Messages name the message they answer. Iterative self-joins enumerate the root-to-leaf paths: runs
of messages with one answer each are first contracted by pointer doubling (a chain of n messages
takes log2(n) joins), then the paths climb from leaf to root over the few branching points left.
Branches of a tree are ranked by the sum of their messages' scores, and each chosen path is written
as one conversation.

Template: `<|turn|>role\\n` text `<|end|>\\n` for each turn. A control string inside a text gets a
backslash after its first character (one more if some are there already), so that no control string
occurs in it; `unescaped` takes exactly that backslash away. Roles are URL-encoded.

A null text is an empty one, a null role an empty role. Rows without a tree or an id are left out. A
parent that isn't there makes its message a root. Messages in a circle of answers are on no path
from a root to a leaf and are left out. Repeated (tree, id) rows are not told apart by an answer, so
ids must be unique; `turn_chains` numbers rows itself, and so takes repeated turns as turns of their
own. Extra columns are ignored. One conversation is one string, so its turns meet in one row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import cut_lineage

TURN, END = "<|turn|>", "<|end|>"
CONTROLS = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _tails(opener: str, controls: tuple[str, ...]) -> str:
    return "|".join(re.sub(r"([|\[\]\\.^$*+?(){}])", r"\\\1", c[1:]) for c in controls if c[0] == opener)


def _pattern(controls: tuple[str, ...], backslashes: str) -> str:
    parts = []
    for opener in sorted({c[0] for c in controls}):
        parts.append(rf"(?<=\{opener}){backslashes}(?=\\*(?:{_tails(opener, controls)}))")
    return "|".join(parts)


def escaped(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    """`text` without control strings: a backslash follows the first character of each."""
    return F.regexp_replace(text, _pattern(controls, ""), r"\\")


def unescaped(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    return F.regexp_replace(text, _pattern(controls, r"\\"), "")


def turn_chains(rows: DataFrame) -> DataFrame:
    """Linear conversations as trees: every turn answers the one before it."""
    mine = rows.select(
        F.col("conv_id").alias("tree"),
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).filter("tree IS NOT NULL")
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    numbered = mine.withColumn("id", F.row_number().over(order).cast("long"))
    return numbered.select(
        "tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text",
        F.lit(0.0).alias("score"),
    )


def reply_paths(messages: DataFrame, top: int | None = None) -> DataFrame:
    """Messages (tree, id, parent, role, text, score) of every root-to-leaf path, or of the `top`
    paths of each tree: tree, leaf, branch (rank from 1), place (turn from 0), role, text."""
    nodes = messages.filter("tree IS NOT NULL AND id IS NOT NULL")
    ids = nodes.select(F.col("tree").alias("t"), F.col("id").alias("p"))
    links = cut_lineage(
        nodes.join(ids, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("p")), "left").select(
            "tree", "id", F.col("p").alias("parent"), F.coalesce("score", F.lit(0.0)).alias("score")
        )
    )
    runs = cut_lineage(_runs(links))
    segments = (
        links.join(runs, ["tree", "id"])
        .groupBy("tree", "end")
        .agg(
            F.max_by(F.struct("parent"), "hops")["parent"].alias("up"),
            F.sum("score").alias("score"),
            F.max("leaf").alias("leaf"),
        )
    )
    segments = cut_lineage(segments)
    paths = _climb(segments)
    total = F.sum("score").over(Window.partitionBy("tree", "leaf"))
    paths = paths.withColumn("total", total)
    best = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))
    ranked = paths.filter("level = 0").select("tree", "leaf", best.alias("branch"))
    if top is not None:
        ranked = ranked.filter(F.col("branch") <= top)
    chosen = paths.join(ranked, ["tree", "leaf"]).select("tree", "leaf", "branch", "level", "end")
    place = F.row_number().over(Window.partitionBy("tree", "leaf").orderBy(F.desc("level"), F.desc("hops"))) - 1
    return (
        chosen.join(runs.select("tree", "id", "end", "hops"), ["tree", "end"])
        .join(nodes.select("tree", "id", "role", "text"), ["tree", "id"])
        .select("tree", "leaf", "branch", place.alias("place"), "role", "text")
    )


def _runs(links: DataFrame) -> DataFrame:
    """(tree, id, end, hops, leaf): where the run of only answers from a message ends, how far that
    is, and whether it ends in a leaf."""
    answers = (
        links.filter("parent IS NOT NULL")
        .groupBy("tree", F.col("parent").alias("id"))
        .agg(F.count("*").alias("n"), F.min("id").alias("child"))
    )
    single = F.coalesce(F.col("n") == 1, F.lit(False))
    state = cut_lineage(
        links.select("tree", "id")
        .join(answers, ["tree", "id"], "left")
        .select(
            "tree", "id", F.when(single, F.col("child")).otherwise(F.col("id")).alias("end"),
            single.cast("long").alias("hops"), F.col("n").isNull().alias("leaf"),
        )
    )
    longest, last = 1, -1
    while True:
        far = state.select(
            "tree", F.col("id").alias("end"), F.col("end").alias("next_end"), F.col("hops").alias("more"),
            F.col("leaf").alias("next_leaf"),
        )
        state = cut_lineage(
            state.join(far, ["tree", "end"]).select(
                "tree", "id", F.col("next_end").alias("end"), (F.col("hops") + F.col("more")).alias("hops"),
                F.col("next_leaf").alias("leaf"),
            )
        )
        longest *= 2
        still = state.filter(F.col("hops") == longest).count()
        if still in (0, last):  # chains still under way get fewer each time; circles do not
            return state.filter(F.col("hops") < longest)
        last = still


def _climb(segments: DataFrame) -> DataFrame:
    """(tree, leaf, end, level, score): the runs of each path, level 0 at the leaf."""
    at = segments.filter("leaf").select(
        "tree", F.col("end").alias("leaf"), "end", F.lit(0).alias("level"), "score", "up"
    )
    found = at
    above = segments.select("tree", F.col("end").alias("e"), F.col("up").alias("u"), F.col("score").alias("s"))
    while True:
        at = cut_lineage(
            at.filter("up IS NOT NULL")
            .withColumnRenamed("tree", "t")
            .join(above, (F.col("t") == F.col("tree")) & (F.col("up") == F.col("e")))
            .select("tree", "leaf", F.col("e").alias("end"), (F.col("level") + 1).alias("level"), F.col("s").alias("score"), F.col("u").alias("up"))
        )
        if not at.take(1):
            return found.drop("up")
        found = found.unionByName(at)


def format_paths(paths: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per path: tree, leaf, branch, formatted, loss_mask (start and end characters of the
    texts of role `learn`, end exclusive)."""
    head = F.concat(F.lit(TURN), F.url_encode("role"), F.lit("\n"))
    turns = paths.select(
        "tree", "leaf", "branch", "place", (F.col("role") == learn).alias("learnt"),
        head.alias("head"), escaped(F.col("text")).alias("body"),
    )
    size = F.length("head") + F.length("body") + len(END) + 1
    before = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    written = F.concat("head", "body", F.lit(END + "\n"))
    span = F.struct(F.col("start"), (F.col("start") + F.length("body")).alias("end"))
    return turns.groupBy("tree", "leaf", "branch").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", written.alias("w")))), lambda x: x["w"]), "").alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("learnt"), span))).alias("loss_mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns of formatted paths: tree, leaf, place, role, text, masked, n_formatted."""
    ends = re.sub(r"([|])", r"\\\1", END) + "\n"
    parts = formatted.select(
        "tree", "leaf", F.length("formatted").alias("n_formatted"), F.posexplode(F.split("formatted", ends)).alias("place", "part")
    ).filter("part <> ''")
    size = F.length("part") + len(END) + 1
    before = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    head = F.expr("instr(part, '\n')")
    turns = parts.select(
        "tree", "leaf", "place", "n_formatted",
        (F.coalesce(F.sum(size).over(before), F.lit(0)) + head).alias("start"),
        F.url_decode(F.expr(f"substring(part, {len(TURN) + 1}, instr(part, '\n') - {len(TURN) + 1})")).alias("role"),
        F.expr("substring(part, instr(part, '\n') + 1)").alias("body"),
    )
    spans = formatted.select("tree", "leaf", F.explode("loss_mask").alias("span")).select(
        F.col("tree").alias("t"), F.col("leaf").alias("l"), F.col("span.start").alias("s"), F.col("span.end").alias("e")
    )
    same = (
        (F.col("tree") == F.col("t")) & (F.col("leaf") == F.col("l")) & (F.col("start") == F.col("s"))
        & (F.col("start") + F.length("body") == F.col("e"))
    )
    return turns.join(spans, same, "left").select(
        "tree", "leaf", "place", "role", unescaped(F.col("body")).alias("text"), F.col("s").isNotNull().alias("masked"), "n_formatted"
    )

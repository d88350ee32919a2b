"""Greedy head clustering, and the nearest vector of another set.

Items are taken in a given order; an item joins the earliest head it is close to, otherwise it
becomes a head itself. Members are never compared with each other, so nothing chains. Closeness is
sharing at least m elements, or a cosine of at least t; see close_pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rankloom.functions.url import url_key
from rankloom.operators.close_pairs import (
    DIGITS,
    MANY,
    close_vectors,
    filled,
    fingerprint,
    ordered_heads,
    overlapping_sets,
    sparse,
    vector_classes,
)
from rankloom.session import cut_lineage


def greedy_set_heads(items: DataFrame, members: DataFrame, min_shared: int) -> DataFrame:
    """(run_id, item, head) for items (run_id, item, order) and distinct members
    (run_id, item, element), for runs of any size. `order` must sort items uniquely within a run."""
    return ordered_heads(items, overlapping_sets(members, min_shared))


def serp_members(serp: DataFrame, top_n: int) -> DataFrame:
    """Distinct overlap keys of the first results: (run_id, item, element)."""
    return (
        serp.filter(F.col("pos") <= top_n)
        .select("run_id", F.col("keyword").alias("item"), url_key(F.col("url")).alias("element"))
        .distinct()
    )


def serp_clusters(
    keywords: DataFrame, serp: DataFrame, order: list[Column], min_shared: int, top_n: int
) -> DataFrame:
    """(run_id, keyword, cluster): the lead keyword of each keyword's group. `order` ranks leads;
    the keyword itself breaks the last tie."""
    ordering = F.struct(
        *[c.alias(f"k{i}") for i, c in enumerate([*order, F.col("keyword")])]
    ).alias("order")
    items = keywords.select("run_id", F.col("keyword").alias("item"), ordering)
    heads = greedy_set_heads(items, serp_members(serp, top_n), min_shared)
    return heads.select(
        "run_id", F.col("item").alias("keyword"), F.col("head").alias("cluster")
    )


def overlap_degree(members: DataFrame, min_shared: int) -> DataFrame:
    """Per run: items that share at least m elements with another item, and items that do not."""
    close = overlapping_sets(members, min_shared).select("run_id", "item").distinct()
    flagged = (
        members.select("run_id", "item")
        .distinct()
        .join(close.withColumn("close", F.lit(1)), ["run_id", "item"], "left")
    )
    return flagged.groupBy("run_id").agg(
        F.count("close").alias("overlapping"), F.count("*").alias("items")
    )


def url_popularity(members: DataFrame) -> DataFrame:
    """Keywords per result page in each run."""
    return members.groupBy("run_id", "element").agg(F.count("*").alias("keywords"))


# --- vectors -----------------------------------------------------------------------------------

def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def greedy_vector_heads(items: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """(run_id, item, head) for items (run_id, item, order, vector) of unit vectors; `order` must sort
    items uniquely within a run. Equal vectors are one class, led by its first item: they are close to
    the same items, so only classes are compared: sparse ones by the prefix join, and where vectors
    have few zeros (embeddings), which the prefix could not thin out, by products with the heads alone."""
    classes, members = vector_classes(items, threshold)
    entries = classes.agg(F.avg(F.size("entries"))).first()[0] or 0
    if entries > MANY:
        heads = dense_heads(classes, threshold, block)
    else:
        pairs = close_vectors(classes, classes, threshold, F.col("l.order") < F.col("r.order"))
        both = pairs.select("run_id", F.array("item", "other").alias("items"))
        groups = both.select("run_id", F.explode("items").alias("item"), *fingerprint(F.col("items")))
        heads = ordered_heads(classes, groups)
    heads = heads.select("run_id", F.col("item").alias("first"), "head")
    return members.join(heads, ["run_id", "first"]).select("run_id", "item", "head")


def _stacked(vectors: pa.ChunkedArray, dims: int) -> np.ndarray:
    rows = vectors.combine_chunks()
    out = np.zeros((len(rows), dims))
    out[np.arange(dims) < _lengths(vectors)[:, None]] = rows.flatten().to_numpy(zero_copy_only=False)
    return out


def _lengths(vectors: pa.ChunkedArray) -> np.ndarray:
    return pc.list_value_length(vectors).to_numpy()


def _first_close(x: np.ndarray, heads: np.ndarray, threshold: float) -> np.ndarray:
    """The number of the first head each row is close to, or -1."""
    close = np.round(x @ heads.T, DIGITS) >= threshold
    return np.where(close.any(axis=1), close.argmax(axis=1), -1)


def head_numbers(x: np.ndarray, threshold: float, step: int = 256) -> np.ndarray:
    """Greedy heads of a block of vectors in their order: the number of each one's head."""
    head, heads = np.full(len(x), -1), np.array([], dtype=int)
    for start in range(0, len(x), step):
        part, mine = x[start : start + step], head[start : start + step]
        if len(heads):
            first = _first_close(part, x[heads], threshold)
            mine[first >= 0] = heads[first[first >= 0]]
        close = np.round(part @ part.T, DIGITS) >= threshold
        for i in range(len(part)):
            if mine[i] < 0:
                mine[close[i] & (mine < 0)] = start + i
                mine[i] = start + i
                heads = np.append(heads, start + i)
    return head


def dense_heads(classes: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """(run_id, item, head) for classes (run_id, item, order, entries), for vectors without many zeros.

    Rounds: a task takes the first undecided vectors of a run, `block` at most, in their order. Whatever
    else is undecided in the run meets only the heads found there, in groups of at most `block`; they come
    before all later heads, so a vector close to one is decided and leaves. Close pairs are never rows:
    what is shuffled is each undecided vector and a block's heads for every group. A round follows for each
    block of vectors that no earlier head is close to.
    """
    width = 1 << (max(1, block // 4).bit_length() - 1)  # places counted together
    dealt = classes.repartitionByRange("run_id", "order").sortWithinPartitions("run_id", "order")
    place = F.monotonically_increasing_id().alias("place")  # rises with run_id and order
    left = cut_lineage(dealt.select("run_id", "item", place, filled(F.col("entries")).alias("vector")))
    columns = "run_id string, item string, place long, vector array<double>, head string"

    def lead(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        head = head_numbers(_stacked(rows["vector"], _lengths(rows["vector"]).max()), threshold)
        n = np.arange(len(head))
        vector = rows["vector"].take(pa.array(n, mask=head != n))
        return _judged(rows, vector, rows["item"].take(pa.array(head)))

    def follow(rows: pa.Table, heads: pa.Table) -> pa.Table:
        heads = heads.sort_by("place")
        dims = max(_lengths(t["vector"]).max() for t in (rows, heads))
        first = _first_close(_stacked(rows["vector"], dims), _stacked(heads["vector"], dims), threshold)
        vector = rows["vector"].take(pa.array(np.arange(len(first)), mask=first >= 0))
        return _judged(rows, vector, heads["head"].take(pa.array(first, mask=first < 0)))

    decided: list[DataFrame] = []
    while True:
        left = left.withColumn("part", F.shiftright("place", width.bit_length() - 1))
        ahead = W.partitionBy("run_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        before = F.coalesce(F.sum("n").over(ahead), F.lit(0))
        parts = left.groupBy("run_id", "part").agg(F.count("*").alias("n"))
        group = F.floor(before / max(1, block - width)).alias("group")
        parts = cut_lineage(parts.select("run_id", "part", group))
        placed = left.join(parts, ["run_id", "part"]).drop("part")
        first = cut_lineage(placed.filter("group = 0").groupBy("run_id").applyInArrow(lead, columns))
        decided.append(first)
        keys = ["run_id", "group"]
        groups = parts.filter("group > 0").select(*[F.col(c).alias(c) for c in keys]).distinct()  # fresh identities
        if groups.isEmpty():
            break
        heads = groups.join(first.filter("vector IS NOT NULL"), "run_id")
        rest = placed.filter("group > 0").groupBy(*keys).cogroup(heads.groupBy(*keys))
        judged = cut_lineage(rest.applyInArrow(follow, columns))
        decided.append(judged.filter("head IS NOT NULL"))
        left = judged.filter("head IS NULL").drop("head")
        if left.isEmpty():
            break
    rows = decided[0]
    for more in decided[1:]:
        rows = rows.unionByName(more)
    return rows.select("run_id", "item", "head")


def _judged(rows: pa.Table, vector: pa.ChunkedArray, head: pa.ChunkedArray) -> pa.Table:
    return pa.table({"run_id": rows["run_id"], "item": rows["item"], "place": rows["place"], "vector": vector, "head": head})


def best_match_above(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(run_id, item, match, similarity): the most similar right vector of each left vector of the same
    run, for those that have one at `threshold` or above; ties to the lowest right `order`. Columns:
    run_id, item, vector, and on the right order."""
    def entries(df: DataFrame, order: Column) -> DataFrame:
        columns = ("run_id", "item", order.alias("order"), sparse(F.col("vector")).alias("entries"))
        return cut_lineage(df.select(*columns))  # read twice; texts are embedded once

    pairs = close_vectors(entries(left, F.lit(0)), entries(right, F.col("order")), threshold)
    best = F.max(F.struct("similarity", (-F.col("other_order")).alias("o"), "other")).alias("best")
    return pairs.groupBy("run_id", "item").agg(best).select(
        "run_id", "item", F.col("best.other").alias("match"), F.col("best.similarity").alias("similarity")
    )


def best_match(
    left: DataFrame, right: DataFrame, block: int = 1024, chunk: int = 8192
) -> DataFrame:
    """(run_id, item, match, similarity): the most similar right vector for every left vector of
    the same run, ties to the lowest right `order`. Columns: run_id, item, order (long), vector.

    Right vectors are hashed into blocks, left vectors into chunks; each task multiplies one chunk
    by one block and returns one row per left vector, and a minimum over blocks finishes the job.
    """
    # fresh column identities, so that both sides may come from one table
    left = left.select(*[F.col(c).alias(c) for c in ("run_id", "item", "vector")])
    right = right.select(*[F.col(c).alias(c) for c in ("run_id", "item", "order", "vector")])
    sizes = right.groupBy("run_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    chunks = left.groupBy("run_id").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    grid = sizes.join(chunks, "run_id")
    r = (
        right.join(grid, "run_id")
        .withColumn("b", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
        .withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    )
    lft = (
        left.join(grid, "run_id")
        .withColumn("c", F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int"))
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    keys = ["run_id", "b", "c"]
    schema = "run_id string, item string, match string, match_order long, similarity double"

    def product(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or others.empty:
            return pd.DataFrame(
                {"run_id": [], "item": [], "match": [], "match_order": [], "similarity": []}
            ).astype({"run_id": str, "item": str, "match": str, "match_order": "int64"})
        others = others.sort_values("order", kind="stable")
        scores = np.round(_matrix(rows["vector"]) @ _matrix(others["vector"]).T, 12)
        at = scores.argmax(axis=1)
        return pd.DataFrame(
            {
                "run_id": rows["run_id"].to_numpy(),
                "item": rows["item"].to_numpy(),
                "match": others["item"].to_numpy()[at],
                "match_order": others["order"].to_numpy()[at],
                "similarity": scores[np.arange(len(rows)), at],
            }
        )

    pairs = (
        lft.select(*keys, "item", "vector")
        .groupBy(*keys)
        .cogroup(r.select(*keys, "item", "order", "vector").groupBy(*keys))
        .applyInPandas(product, schema)
    )
    best = F.max(F.struct("similarity", (-F.col("match_order")).alias("o"), "match"))
    return (
        pairs.groupBy("run_id", "item")
        .agg(best.alias("best"))
        .select(
            "run_id",
            "item",
            F.col("best.match").alias("match"),
            F.col("best.similarity").alias("similarity"),
        )
    )

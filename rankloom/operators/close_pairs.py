"""Which items of a run are close: exact joins by prefix filters, and greedy heads over them.

Two measures: sets that share at least m elements, and unit vectors with a cosine of at least t. Both
sort an item's parts by how rare they are in the run and index only a prefix of them, since two close
items must share a part of both prefixes. Candidates are then verified in full.

Closeness is passed on as groups (run_id, item, f1, f2): two items are close exactly when they have a
group in common. A verified pair is a group of two; a set of elements that many items share is one
group of them all, so a popular element never becomes the square of its holders. Groups are named by
128-bit fingerprints, elements by 64-bit ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.binding import bind
from rankloom.session import cut_lineage

GROUP = ["run_id", "f1", "f2"]
ITEM = ["run_id", "item"]
HOT = 64  # holders of an element in a run from which groups replace pairs
SLACK = 1e-9  # for the bounds on sums of floats; verification rounds to DIGITS
DIGITS = 12
MANY = 16  # entries from which a vector is looked up by position


def fingerprint(*parts: Column) -> list[Column]:
    return [F.xxhash64(*parts).alias("f1"), F.xxhash64(F.lit("second"), *parts).alias("f2")]


def subsets(elements: Column, m: int) -> Column:
    """All m-element subsets of an array, as arrays in its order."""
    if m == 0:
        return F.array(F.array().cast("array<bigint>"))

    def from_index(e: Column, i: Column) -> Column:
        rest = F.slice(elements, i + 2, F.size(elements))
        return F.transform(subsets(rest, m - 1), lambda tail: F.concat(F.array(e), tail))

    return F.flatten(F.transform(elements, from_index))


# --- sets --------------------------------------------------------------------------------------


def overlapping_sets(members: DataFrame, min_shared: int, hot: int = HOT) -> DataFrame:
    """Groups of items that share `min_shared` elements. members: run_id, item, element, distinct.

    Elements held by one item are dropped, the others sorted rarest first. If two sets of n and k
    elements share m, the rarest shared one is among the first n-m+1 and k-m+1: only those are
    indexed, with their positions, which bound how many more can be shared. Holders of an element
    are paired and their whole sets compared; a pair is kept at its rarest shared element, so it
    comes out once. Holders of a hot element are not paired: the m-element sets that start with it
    are groups as they are.
    """
    counted = (
        members.groupBy("run_id", "element").agg(F.count("*").alias("n")).filter("n > 1")
    )
    part = F.struct("n", F.xxhash64("element").alias("e"))
    sets = (
        members.join(counted, ["run_id", "element"])
        .groupBy(*ITEM)
        .agg(F.array_sort(F.collect_list(part)).alias("parts"))
        .withColumn("size", F.size("parts"))
        .filter(F.col("size") >= min_shared)
    )
    indexed = cut_lineage(
        sets.select(
            *ITEM,
            "size",
            F.transform("parts", lambda p: p["e"]).alias("elements"),
            F.posexplode(F.slice("parts", 1, F.col("size") - (min_shared - 1))).alias("at", "part"),
        ).select(*ITEM, "size", "elements", "at", "part.n", "part.e")
    )
    cold = indexed.filter(F.col("n") <= hot)
    a, b = cold.alias("a"), cold.alias("b")
    shared = F.array_intersect("a.elements", "b.elements")
    room = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))
    same = (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.e") == F.col("b.e"))
    cheap = (F.col("a.item") < F.col("b.item")) & (room >= min_shared)
    whole = (F.size(shared) >= min_shared) & (F.element_at(shared, 1) == F.col("a.e"))
    # one condition, so that whole sets are compared only where the cheap tests hold
    pairs = (
        a.join(b, same & F.when(cheap, whole).otherwise(False))
        .select("a.run_id", F.array("a.item", "b.item").alias("items"))
        .select("run_id", F.explode("items").alias("item"), *fingerprint(F.col("items")))
    )
    rest = F.slice("elements", F.col("at") + 2, F.col("size"))
    crowds = (
        indexed.filter(F.col("n") > hot)
        .select(*ITEM, "e", F.explode(subsets(rest, min_shared - 1)).alias("others"))
        .select(*ITEM, *fingerprint(F.col("e"), F.col("others")))
    )
    met = crowds.groupBy(*GROUP).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return pairs.unionByName(crowds.join(met, GROUP, "left_semi"))


# --- vectors -----------------------------------------------------------------------------------


def sparse(vector: Column) -> Column:
    """The entries of an array that are not zero: array of (d, w)."""
    entries = F.transform(vector, lambda x, i: F.struct(i.alias("d"), x.cast("double").alias("w")))
    return F.filter(entries, lambda e: e["w"] != 0)


def _ordered(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Entries sorted by how rare their dimension is in the run; dimensions the other side lacks sort
    first, so that they cost index rows but no candidates."""
    keyed = F.transform(
        "entries",
        lambda e: F.struct(
            F.coalesce(F.try_element_at("held", e["d"]), F.lit(0)).alias("n"),
            e["d"].alias("d"),
            e["w"].alias("w"),
        ),
    )
    return rows.join(counts, "run_id").withColumn("entries", F.array_sort(keyed)).drop("held")


def _prefixes(rows: DataFrame, threshold: float) -> DataFrame:
    """An index row for every entry of a vector's prefix: d, w, rest, before and the columns of `rows`.
    `rest` is the norm of what follows the entry, `before` the dimensions ahead of it; the prefix ends once what is left is shorter than
    the threshold, as its product with any unit vector then stays below it."""
    tail = F.transform(
        "entries",
        lambda e, i: F.struct(
            e["d"].alias("d"),
            e["w"].alias("w"),
            F.aggregate(
                F.slice("entries", i + 2, F.size("entries")), F.lit(0.0), lambda s, x: s + x["w"] * x["w"]
            ).alias("rest2"),
        ),
    )
    needed = F.filter(tail, lambda x: x["w"] * x["w"] + x["rest2"] >= threshold * threshold - SLACK)
    return rows.select("*", F.posexplode(needed).alias("at", "x")).select(
        *rows.columns,
        "x.d",
        "x.w",
        F.sqrt("x.rest2").alias("rest"),
        F.transform(F.slice("entries", 1, F.col("at")), lambda e: e["d"]).alias("before"),
    )


def _lookup(entries: Column) -> Column:
    """A vector to look weights up in: a map, or an array once it has many entries."""
    as_map = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["d"], e["w"])))
    many = F.size(entries) > MANY
    reach = F.sequence(F.lit(0), F.array_max(F.transform(entries, lambda e: e["d"])))
    dense = F.transform(reach, lambda i: F.coalesce(F.try_element_at(as_map, i), F.lit(0.0)))
    return F.struct(F.when(~many, as_map).alias("few"), F.when(many, dense).alias("many"))


def filled(entries: Column) -> Column:
    """The array that `entries` came from, without the zeros at its end."""

    def put_back(as_map: Column) -> Column:
        reach = F.sequence(F.lit(0), F.array_max(F.map_keys(as_map)))
        return F.transform(reach, lambda i: F.coalesce(F.try_element_at(as_map, i), F.lit(0.0)))

    last = F.coalesce(F.array_max(F.transform(entries, lambda e: e["d"])), F.lit(-1))
    as_map = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["d"], e["w"])))
    without_zeros = F.transform(entries, lambda e: e["w"])
    return F.when(F.size(entries) == last + 1, without_zeros).otherwise(bind(as_map, put_back))


def _dot(entries: Column, other: Column) -> Column:
    def total(weight) -> Column:
        return F.aggregate(
            entries, F.lit(0.0), lambda s, e: s + e["w"] * F.coalesce(weight(e["d"]), F.lit(0.0))
        )

    few, many = other["few"], other["many"]
    return F.when(few.isNotNull(), total(lambda d: F.try_element_at(few, d))).otherwise(
        total(lambda d: F.try_element_at(many, d + 1))
    )


def close_vectors(
    left: DataFrame, right: DataFrame, threshold: float, only: Column | None = None
) -> DataFrame:
    """(run_id, item, order, other, other_order, similarity): pairs of unit vectors of a run whose
    cosine, rounded to 12 digits, is at least `threshold` (above 0). Columns: run_id, item, order,
    entries (see `sparse`). `only` is a further condition on `l.order` and `r.order`.

    Both sides index a prefix of their entries, rarest dimension of the run first, and meet on (run_id,
    dimension). A pair is judged once, at the first dimension it shares in that order: the product there
    plus the product of what follows on both sides bounds the cosine, so most candidates end before
    the full product. Rows follow the candidates, not left times right. Vectors without zeros all share
    their first dimension: see clusters.dense_heads.
    """
    held = (
        right.select("run_id", F.explode("entries.d").alias("d"))
        .groupBy("run_id", "d")
        .agg(F.count("*").alias("n"))
        .groupBy("run_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("held"))
    )
    columns = ["run_id", "item", "order", "entries"]
    lft = _prefixes(_ordered(left.select(*columns), held), threshold)
    ordered = _ordered(right.select(*columns), held).withColumn("lookup", _lookup(F.col("entries")))
    rgt = _prefixes(ordered, threshold).drop("entries")
    lft, rgt = lft.alias("l"), rgt.alias("r")
    bound = F.abs(F.col("l.w") * F.col("r.w")) + F.col("l.rest") * F.col("r.rest")
    cheap = (bound >= threshold - SLACK) & ~F.arrays_overlap("l.before", "r.before")
    if only is not None:
        cheap = only & cheap
    similarity = F.round(_dot(F.col("l.entries"), F.col("r.lookup")), DIGITS)
    # one condition, so that the product is formed only where the cheap tests hold
    close = F.when(cheap, similarity >= threshold).otherwise(False)
    met = (F.col("l.run_id") == F.col("r.run_id")) & (F.col("l.d") == F.col("r.d"))
    return lft.join(rgt, met & close).select(
        "l.run_id",
        "l.item",
        "l.order",
        F.col("r.item").alias("other"),
        F.col("r.order").alias("other_order"),
        similarity.alias("similarity"),
    )


def vector_classes(items: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Items (run_id, item, order, vector) as classes of equal vectors: one row per class (its first
    item, with `entries`), and (run_id, item, first) of every item. A vector too short to be close to
    its own copy (no words, no vector) is a class of its own."""
    entries = F.col("entries")
    square = F.aggregate(entries, F.lit(0.0), lambda s, e: s + e["w"] * e["w"])
    alone = F.when(F.round(square, DIGITS) < threshold, F.col("item"))
    keyed = items.select(
        F.col("run_id").cast("string").alias("run_id"),
        F.col("item").cast("string").alias("item"),
        "order",
        sparse(F.coalesce("vector", F.array())).alias("entries"),
    ).select("*", *fingerprint(entries, alone))
    keyed = cut_lineage(keyed)
    first = F.min(F.struct("order", "item", "entries")).alias("x")
    classes = keyed.groupBy(*GROUP).agg(first).select(*GROUP, "x.order", "x.item", "x.entries")
    classes = cut_lineage(classes)
    named = classes.select(*GROUP, F.col("item").alias("first"))
    return classes.drop("f1", "f2"), keyed.select(*GROUP, "item").join(named, GROUP).select(*ITEM, "first")


# --- heads -------------------------------------------------------------------------------------


def ordered_heads(items: DataFrame, groups: DataFrame) -> DataFrame:
    """(run_id, item, head). Items (run_id, item, order) are taken by rising `order`, which is unique in
    a run: an item joins the earliest head it is close to, otherwise it becomes a head.

    Rounds: an undecided item that is first among the undecided of all its groups is a head, and
    whoever shares a group with it is decided. Groups of decided items are dropped, so every round
    works on what is left; their number grows with the logarithm of the run. An item left without
    groups is a head. A group's members are only ever counted and joined, never paired.
    """
    keyed = cut_lineage(groups.join(items.select(*ITEM, "order"), ITEM))
    open_rows = keyed
    leads: list[DataFrame] = []
    while True:
        first = open_rows.groupBy(*GROUP).agg(F.min("order").alias("first"))
        waits = open_rows.join(first, GROUP).groupBy(*ITEM).agg(
            F.bool_or(F.col("order") > F.col("first")).alias("waits")
        )
        judged = cut_lineage(open_rows.join(waits, ITEM))
        lead = judged.filter("NOT waits")
        leads.append(lead.select(*GROUP, F.struct("order", "item").alias("owner")))
        taken = lead.select(*GROUP).distinct()
        decided = judged.join(taken, GROUP, "left_semi").select(*ITEM).distinct()
        open_rows = cut_lineage(judged.drop("waits").join(decided, ITEM, "left_anti"))
        if open_rows.isEmpty():
            break
    owners = leads[0]
    for more in leads[1:]:
        owners = owners.unionByName(more)
    # at most one head owns a group: two heads are never close
    joined = keyed.join(owners, GROUP).groupBy(*ITEM).agg(F.min("owner")["item"].alias("head"))
    return items.join(joined, ITEM, "left").select(*ITEM, F.coalesce("head", "item").alias("head"))

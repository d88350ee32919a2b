"""Best-fit packing after Martello-Toth dominance reduction.

Every text becomes tokens and one end id; texts longer than a sequence are cut into full pieces and
a rest. Since lengths are whole numbers up to the capacity, the packing instance is the number of
pieces of each length: at most `capacity` numbers, whatever the corpus holds. They alone go to the
driver, where whole groups of equal lengths are packed at once:

1. Reduction. For the longest remaining length x, a set of pieces that fills the gap capacity - x
   exactly with one piece dominates every other set that could share x's sequence, and when even
   the smallest remaining piece does not fit, x alone dominates. If only single pieces can join x
   (the two smallest exceed the gap together), the largest piece that fits dominates all. Such
   sequences are fixed for good, and the test is repeated on the smaller instance.
2. What no dominance settles is packed best fit: longest first, then the largest pieces that still
   fit, preferring pairs and triples that close the gap exactly.

The result is a list of patterns (lengths side by side, and how often), of size bounded by the
capacity. Pieces of a length are numbered in parallel (a count per bucket and a rank within it), and
a number finds its pattern by a lookup, so no group of equal lengths is ever gathered anywhere.

Null or empty text: the end id alone. Repeated rows are packed each. Extra columns are ignored. No
documents: no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import cut_lineage, documents, map_batches
from rankloom.llm.text_arrays import pieces
from rankloom.llm.token_ids import CellCache, little_endian

CAPACITY = 2048
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
Pattern = tuple[tuple[int, ...], int]  # lengths in a sequence, longest first; number of sequences


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = cut_lineage(token_pieces(docs, path, capacity, end_id))
    return place(cut, capacity)


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    def step(batch: pa.RecordBatch):
        cache = CellCache.of(path, little_endian)
        end = little_endian([end_id])
        for lo, hi, _, _ in pieces(batch.column("text")):
            texts = batch.column("text").slice(lo, hi - lo).to_pylist()
            ids = batch.column("doc_id").slice(lo, hi - lo).to_pylist()
            cells = [text.replace("\n", " ").split(" ") for text in texts]
            cache.ask({c for own in cells for c in own})
            rows = []
            for doc_id, own in zip(ids, cells, strict=True):
                raw = b"".join(map(cache.__getitem__, own)) + end
                for number, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc_id, number, at // 4, len(part) // 4, zlib.crc32(part)))
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    return map_batches(documents(docs), step, PIECES)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences and offsets for pieces that have a length."""
    spark = cut.sparkSession
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    spread = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in spread.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = np.array(sorted(_slots(best_fit(histogram, capacity))), np.int64).reshape(-1, 4)
    held = spark.sparkContext.broadcast(slots)  # a few rows per length at most

    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = spread.select(
        F.col("length").alias("l"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = (
        cut.withColumn("rank", F.row_number().over(within) - 1)
        .join(base, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b")))
        .withColumn("number", F.col("base") + F.col("rank"))
        .drop("l", "b", "base", "rank", "bucket")
    )

    def step(batch: pa.RecordBatch):
        table = held.value
        length, number = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "number"))
        at = np.searchsorted((table[:, 0] << 48) + table[:, 1], (length << 48) + number, "right") - 1
        columns = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
        return columns | {"sequence_id": table[at, 2] + number - table[at, 1], "offset": table[at, 3]}

    return map_batches(numbered, step, PIECES + ", sequence_id long, offset long")


def _slots(patterns: list[Pattern]) -> Iterator[tuple[int, int, int, int]]:
    """(length, first number, first sequence, offset) for each place of each pattern."""
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            low = used.get(length, 0)
            used[length] = low + times
            yield length, low, sequence, offset
            offset += length
        sequence += times


def best_fit(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that pack every piece of a histogram of lengths."""
    left = {length: n for length, n in histogram.items() if n > 0}
    order = sorted(left)  # lengths with pieces left, ascending
    out: list[Pattern] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        out.append((lengths, times))
        for length in lengths:
            left[length] -= times
        for length in set(lengths):
            if not left[length]:
                order.remove(length)

    while order:
        longest = order[-1]
        chosen = _dominating(order, left, longest, capacity) or _fill(order, left, longest, capacity)
        times = min(left[x] // chosen.count(x) for x in set(chosen))
        take(chosen, max(1, times))
    return out


def _dominating(order: list[int], left: dict[int, int], longest: int, capacity: int) -> tuple[int, ...] | None:
    """A set with the longest piece that no other set with it can beat, if there is one."""
    gap = capacity - longest
    rest = [x for x in order[:2] if x != longest or left[longest] > 1]
    if not rest or rest[0] > gap:
        return (longest,)
    enough = 2 if gap == longest else 1
    if left.get(gap, 0) >= enough:
        return (longest, gap)
    smallest = rest[0]
    second = smallest if left[smallest] > (2 if smallest == longest else 1) else (rest[1] if len(rest) > 1 else capacity + 1)
    if smallest + second > gap:  # one companion at most: the largest that fits
        at = bisect_right(order, gap) - 1
        best = order[at]
        if best == longest and left[longest] < 2:
            best = order[at - 1]
        return (longest, best)
    return None


def _fill(order: list[int], left: dict[int, int], longest: int, capacity: int) -> tuple[int, ...]:
    """Best fit for the rest of a sequence: close the gap exactly with two pieces if possible,
    else take the largest piece that fits, again and again."""
    chosen = [longest]
    gap = capacity - longest
    free = lambda x: left[x] - chosen.count(x)
    while gap >= order[0]:
        if gap in left and left[gap] and free(gap) > 0:
            chosen.append(gap)
            break
        pair = _pair(order, free, gap)
        if pair:
            chosen += pair
            break
        at = bisect_right(order, gap) - 1
        while at >= 0 and free(order[at]) <= 0:
            at -= 1
        if at < 0:
            break
        chosen.append(order[at])
        gap -= order[at]
    return tuple(chosen)


def _pair(order: list[int], free, gap: int) -> list[int] | None:
    """Two pieces that fill the gap exactly, the larger one as large as possible."""
    low, high = 0, bisect_right(order, gap) - 1
    while low <= high:
        total = order[low] + order[high]
        if total == gap and free(order[high]) > 0 and free(order[low]) > (1 if low == high else 0):
            return [order[high], order[low]]
        if total > gap:
            high -= 1
        else:
            low += 1
    return None

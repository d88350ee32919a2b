"""Importance resampling towards a target: draw the documents most like the benchmark.

Features are all runs of 1 to 3 words, hashed into `buckets` by crc32. One 256-byte table lower-cases
A-Z and turns every separator into a space, which works on UTF-8 as it is (bytes beyond ASCII are
letters); `bytes.split` then yields words. The checksum of a longer run continues that of the run
before (`crc32(b" " + word, seed)`), so no run is ever joined. Counters hold a task's bucket counts,
Spark adds them up. A bucket's gain is the log ratio of its share in the target and in all documents,
in floored thousandths; a document's weight is the sum over its features.

Weights are perturbed by Gumbel noise from a hash of the document's id, and the highest scores are
drawn: a draw without replacement in proportion to the likelihood ratio. Ranks come from one range
partitioning by score and running counts of its partitions, so no task sees all documents.

At most `buckets` counts of either side reach the driver, and their gains are broadcast. A text is
worked through in chunks of CHUNK_BYTES; a run across two chunks counts once.

Null or empty text: no features, weight 0, never drawn when a least number of words is asked. Repeated
rows, also of one doc_id, are rows of their own. Rows without a doc_id count among all documents'
features, have no score and are never drawn. An empty target has no feature in any bucket; no
documents: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import cut_lineage, documents

BUCKETS = 10_000
MIN_WORDS = 20
DRAW_PERCENT = 5
SEED = "42"
CHUNK_BYTES = 1 << 20

# bytes of the word class stay (0-9, a-z, beyond ASCII), A-Z become lower case, the rest a space
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def chunks(raw: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """Translated pieces of a text of about `size` bytes that end between words."""
    at = 0
    while at < len(raw):
        part = raw[at : at + size].translate(TABLE)
        at += size
        while at < len(raw) and not part.endswith(b" "):  # a word goes on: up to the next space
            more = raw[at : at + size].translate(TABLE)
            cut = more.find(b" ") + 1 or len(more)
            part, at = part + more[:cut], at + cut
        yield part


def features(raw: bytes, size: int = CHUNK_BYTES) -> Iterator[tuple[int, list[list[int]]]]:
    """(number of words, checksums of the runs of 1, 2 and 3 words) of each chunk of a text."""
    last: list[bytes] = []  # the two words before the chunk
    for part in chunks(raw, size):
        new = part.split()
        words = last + new
        spaced = [b" " + w for w in words]
        one = list(map(crc32, words))
        two = list(map(crc32, spaced[1:], one))
        three = list(map(crc32, spaced[2:], two))
        held = len(last)
        yield len(new), [one[held:], two[max(held - 1, 0) :], three]
        last = words[-2:]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> dict[int, int]:
    """How many features of all texts fall into each bucket: at most `buckets` rows on the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                for _, runs in features(text.as_py()):
                    for run in runs:
                        found.update((np.array(run, np.int64) % buckets).tolist())
        yield pa.RecordBatch.from_pydict(
            {"bucket": pa.array(list(found), pa.int64()), "n": pa.array(list(found.values()), pa.int64())}
        )

    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n"))
    return dict(map(tuple, rows.collect()))


def gains(all_counts: dict[int, int], target_counts: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln(share in the target / share in all documents)) of each bucket, shares with one
    feature more in every bucket."""
    total, target = sum(all_counts.values()), sum(target_counts.values())
    s = np.array([all_counts.get(b, 0) for b in range(buckets)], np.float64)
    t = np.array([target_counts.get(b, 0) for b in range(buckets)], np.float64)
    return np.floor(1000 * np.log((t + 1) * (total + buckets) / ((s + 1) * (target + buckets)))).astype(np.int64)


def weights(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of (doc_id, text), row by row."""
    held = texts.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for text in batch.column("text").cast(pa.large_binary()):
                n_words = n_features = weight = 0
                for many, runs in features(text.as_py()):
                    n_words += many
                    for run in runs:
                        n_features += len(run)
                        weight += int(gain[np.array(run, np.int64) % len(gain)].sum())
                rows.append((n_words, n_features, weight))
            made = zip(*rows, strict=True) if rows else ([], [], [])
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in made)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return texts.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in floored thousandths, from the first 8 hexadecimal digits of a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = DRAW_PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    seed: str = SEED,
    target_text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (null if not drawn)."""
    texts = documents(docs)
    aim = target.select(F.coalesce(target[f"`{target_text_col}`"].cast("string"), F.lit("")).alias("text"))
    gain = gains(bucket_counts(texts, buckets), bucket_counts(aim, buckets), buckets)
    scored = weights(texts, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return draw_highest(scored, percent, F.col("doc_id").isNotNull() & (F.col("n_words") >= min_words))


def draw_highest(scored: DataFrame, percent: int, eligible: Column) -> DataFrame:
    """`scored` (doc_id, score, ...) with `rank`: 1, 2, 3... by falling score, equal scores by rising
    doc_id, for the first `percent` of the eligible rows; null for all others."""
    rows = cut_lineage(scored.withColumn("open", F.coalesce(eligible, F.lit(False))))
    high, low = F.col("score").desc(), F.col("doc_id").asc()
    # rows that can't be drawn stay where they are; the others are dealt by range of score
    dealt = rows.filter("open").repartitionByRange(high, low).withColumn("part", F.spark_partition_id())
    ranged = cut_lineage(dealt)
    sizes = ranged.groupBy("part").count().collect()  # one row per partition
    n_open = sum(r["count"] for r in sizes)
    before, done = [], 0
    for part, many in sorted(map(tuple, sizes)):
        before.append((part, done))
        done += many
    starts = scored.sparkSession.createDataFrame(before, "start_part int, start long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(high, low))
    drawn = (
        ranged.withColumn("place", place)
        .join(F.broadcast(starts), F.col("part") == F.col("start_part"))  # one row per partition
        .withColumn("rank", F.col("start") + F.col("place"))
        .withColumn("rank", F.when(F.col("rank") <= F.lit(percent * n_open // 100), F.col("rank")))
    )
    others = rows.filter("NOT open").withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(others.columns).unionByName(others).drop("open")

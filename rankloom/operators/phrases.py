"""Page phrases: n-gram counts, hashed word vectors, page vectors and diverse selection.

An embedder is any function DataFrame -> DataFrame that adds a unit vector to a text column; the
default hashes stemmed content words, so texts sharing content words are similar.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rankloom import fixed_values as fv
from rankloom.functions.binding import bind
from rankloom.functions.numeric import half_even, unit
from rankloom.functions.text import content_words, passages, truncate_words
from rankloom.settings import Thresholds

DIMS = 256
PAGES_AT_ONCE = 256  # whose phrases are in one batch
_WORD_OR_BREAK, _SENTENCE_BREAK = re.compile(fv.WORD_PATTERN + r"|\n"), re.compile(fv.SENTENCE_BREAK)
_STOP = frozenset(fv.STOPWORDS)
Embedder = Callable[[DataFrame, str, str], DataFrame]


def hashed_entries(text: Column) -> Column:
    """Sparse unit vector: array of (bucket, weight). The bucket of a word is the last byte of its
    MD5, which is its MD5 modulo 256. Sorting makes equal buckets neighbours, so counting is a
    position difference instead of a scan per bucket."""
    buckets = F.transform(
        content_words(text),
        lambda w: F.conv(F.right(F.md5(w.cast("binary")), F.lit(2)), 16, 10).cast("int"),
    )

    def counts(b: Column) -> Column:
        ends = F.filter(
            F.transform(
                b,
                lambda x, i: F.struct(
                    x.alias("bucket"),
                    i.alias("at"),
                    (F.try_element_at(b, i + 2).isNull() | (F.try_element_at(b, i + 2) != x)).alias(
                        "last"
                    ),
                ),
            ),
            lambda e: e["last"],
        )
        return bind(
            ends,
            lambda e: F.transform(
                e,
                lambda x, j: F.struct(
                    x["bucket"].alias("bucket"),
                    (x["at"] - F.coalesce(F.when(j > 0, F.try_element_at(e, j)["at"]), F.lit(-1)))
                    .cast("double")
                    .alias("weight"),
                ),
            ),
        )

    def scaled(c: Column) -> Column:
        norm = F.sqrt(
            F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x["weight"] * x["weight"])
        )
        return bind(
            F.struct(c.alias("c"), norm.alias("norm")),
            lambda p: F.transform(
                p["c"],
                lambda x: F.struct(
                    x["bucket"].alias("bucket"), (x["weight"] / p["norm"]).alias("weight")
                ),
            ),
        )

    return bind(bind(F.array_sort(buckets), counts), scaled)


def dense(entries: Column, dims: int = DIMS) -> Column:
    return bind(
        F.map_from_entries(entries),
        lambda m: F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)),
        ),
    )


def hashed_embedder(df: DataFrame, text: str, vector: str) -> DataFrame:
    return df.withColumn("_entries", hashed_entries(F.col(text))).withColumn(
        vector, dense(F.col("_entries"))
    ).drop("_entries")


def page_passages(pages: DataFrame, t: Thresholds, *more: str) -> DataFrame:
    """(run_id, page, passage_no, passage) of each page, or of its first page_words words, and the columns `more`."""
    cut = F.col("text") if t.page_words is None else truncate_words(F.col("text"), t.page_words)
    return pages.select(
        "run_id", "page", *more, F.posexplode_outer(passages(cut, t.passage_words)).alias("n", "passage")
    ).filter(F.col("passage").isNotNull()).select("run_id", "page", *more, (F.col("n") + 1).alias("passage_no"), "passage")


def page_vectors(pages: DataFrame, t: Thresholds) -> DataFrame:
    """(run_id, page, vector): normalised mean of the passage vectors, summed per word bucket so
    the shuffle carries partial sums, not vectors."""
    chunks = pages.select(
        "run_id", "page", F.explode_outer(passages(F.col("text"), t.passage_words)).alias("passage")
    )
    weights = (
        chunks.select("run_id", "page", F.inline_outer(hashed_entries(F.col("passage"))))
        .filter(F.col("bucket").isNotNull())
        .groupBy("run_id", "page", "bucket")
        .agg(F.sum("weight").alias("weight"))
    )
    return (
        weights.groupBy("run_id", "page")
        .agg(F.collect_list(F.struct("bucket", "weight")).alias("entries"))
        .select("run_id", "page", unit(dense(F.col("entries"))).alias("vector"))
    )


def mean_vectors(rows: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """Normalised mean of landed vectors per key, dimension by dimension."""
    parts = (
        rows.select(*keys, F.posexplode(vector).alias("dim", "x"))
        .groupBy(*keys, "dim")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return (
        parts.groupBy(*keys)
        .agg(F.transform(ordered, lambda e: e["x"]).alias("mean"))
        .select(*keys, unit(F.col("mean")).alias(vector))
    )


def ngrams(docs: DataFrame, limit: int = 200) -> DataFrame:
    """(run_id, page, gram, n, place): the most frequent phrases of each page. The texts of a page meet
    in one row and its grams are counted there, so texts are shuffled once and grams never are."""
    schema = docs.select("run_id", "page").schema.add("gram", "string").add("n", "long").add("place", "integer")
    return page_texts(docs).mapInArrow(lambda batches: _frequent_grams(batches, limit), schema)


def page_texts(docs: DataFrame) -> DataFrame:
    """(run_id, page, texts): the lower-case texts of each page."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        # a given number, as few bytes make much work here and would be put into few tasks
        docs.repartition(parts, "run_id", "page")
        .groupBy("run_id", "page")
        .agg(F.collect_list(F.lower("text")).alias("texts"))
    )


def _gram_counts(texts: list[str]) -> Counter[str]:
    return Counter(chain.from_iterable(map(grams_of, texts)))


def _frequent_grams(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """run_id, page and lower-case texts -> the most frequent grams of each page, ties in their order."""
    for batch in batches:
        for from_ in range(0, batch.num_rows, PAGES_AT_ONCE):
            part = batch.slice(from_, PAGES_AT_ONCE)
            rows, grams, ns, places = [], [], [], []
            for row, texts in enumerate(part.column("texts")):
                counts = _gram_counts(texts.as_py())
                best = most_frequent(counts, limit)
                rows += [row] * len(best)
                grams += best
                ns += [counts[gram] for gram in best]
                places += range(1, len(best) + 1)
            of = pa.array(rows, pa.int64())
            columns = [part.column("run_id").take(of), part.column("page").take(of)]
            columns += [pa.array(grams, pa.string()), pa.array(ns, pa.int64()), pa.array(places, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["run_id", "page", "gram", "n", "place"])


def most_frequent(counts: Counter[str], limit: int) -> list[str]:
    """The grams counted most, ties in their order, at most `limit`: only those at the edge are compared."""
    if len(counts) > limit:
        edge = sorted(counts.values(), reverse=True)[limit - 1] if limit else 0
        above = [gram for gram, n in counts.items() if n > edge]
        ties = heapq.nsmallest(limit - len(above), [gram for gram, n in counts.items() if n == edge])
    else:
        above, ties = list(counts), []
    return sorted(above, key=lambda gram: (-counts[gram], gram)) + ties


def grams_of(low: str) -> list[str]:
    """`sentence_grams` of a lower-case text, in any order."""
    w = _WORD_OR_BREAK.findall(_SENTENCE_BREAK.sub("\n", low))
    inner = [x != "\n" and not x.isdigit() for x in w]  # grams hold no all-digit words
    edge = [ok and x not in _STOP for x, ok in zip(w, inner, strict=True)]
    found = [f"{a} {b}" for a, b, x, y in zip(w, w[1:], edge, edge[1:]) if x and y]
    threes = zip(w, w[1:], w[2:], edge, inner[1:], edge[2:])
    found += [f"{a} {b} {c}" for a, b, c, x, i, y in threes if x and y and i]
    fours = zip(w, w[1:], w[2:], w[3:], edge, inner[1:], inner[2:], edge[3:])
    found += [f"{a} {b} {c} {d}" for a, b, c, d, x, i, j, y in fours if x and y and i and j]
    return found


def mmr_order(relevance: np.ndarray, vectors: np.ndarray, top_n: int, diversity: float):
    """Indices of relevant but mutually different rows, ties to the lowest index."""
    score = np.round(relevance, 12)
    redundancy = np.full(len(vectors), -np.inf)
    chosen: list[int] = []
    free = np.ones(len(vectors), dtype=bool)
    while free.any() and len(chosen) < top_n:
        best = int(np.flatnonzero(free)[np.argmax(score[free])])
        chosen.append(best)
        free[best] = False
        redundancy = np.maximum(redundancy, vectors @ vectors[best])
        score = np.round((1 - diversity) * relevance - diversity * redundancy, 12)
    return chosen


@lru_cache(maxsize=1 << 16)
def _bucket(word: str) -> int:
    stem = word[:-1] if word.endswith("s") and len(word) > 3 else word
    return hashlib.md5(stem.encode(), usedforsecurity=False).digest()[-1]


def gram_vectors(grams: list[str]) -> np.ndarray:
    """`hashed_entries` of grams as the rows of a matrix."""
    vectors = np.zeros((len(grams), DIMS))
    at = [(i, _bucket(w)) for i, gram in enumerate(grams) for w in gram.split(" ") if w not in _STOP]
    np.add.at(vectors, tuple(np.array(at, int).reshape(-1, 2).T), 1.0)
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, norms, out=vectors, where=norms > 0)


def _diverse_grams(batches: Iterator[pa.RecordBatch], pool: int, top_n: int, diversity: float) -> Iterator[pa.RecordBatch]:
    """run_id, page, lower-case texts and the page's vector -> its maximal marginal relevance phrases, chosen
    from its most frequent grams."""
    for batch in batches:
        rows, phrases, places = [], [], []
        for row, (texts, target) in enumerate(zip(batch.column("texts"), batch.column("page_vector"), strict=True)):
            grams = most_frequent(_gram_counts(texts.as_py()), pool)
            vectors = gram_vectors(grams)
            chosen = mmr_order(vectors @ target.values.to_numpy(), vectors, top_n, diversity) if grams else []
            rows += [row] * len(chosen)
            phrases += [grams[i] for i in chosen]
            places += range(1, len(chosen) + 1)
        of = pa.array(rows, pa.int64())
        columns = [batch.column("run_id").take(of), batch.column("page").take(of)]
        columns += [pa.array(phrases, pa.string()), pa.array(places, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["run_id", "page", "phrase", "place"])


def page_phrases(docs: DataFrame, t: Thresholds) -> DataFrame:
    """Relevant, diverse phrases of each page: n-grams, hashed vectors, then the selection, all where the
    texts of the page are, as its grams are several times its text."""
    pages = docs.select(
        F.col("run_id").cast("string").alias("run_id"),
        F.col("page").cast("string").alias("page"),
        "text",
    )
    vectors = page_vectors(pages, t).withColumnRenamed("vector", "page_vector")
    pool, top_n, diversity = t.phrase_pool, t.page_phrases, t.mmr_diversity
    return page_texts(pages).join(vectors, ["run_id", "page"]).mapInArrow(
        lambda batches: _diverse_grams(batches, pool, top_n, diversity),
        "run_id string, page string, phrase string, place int",
    )


def phrase_fit(phrases: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds `fit`: cosine of a phrase and the run's page vector, at least 0, four decimals.
    Sparse against dense, so a phrase costs as many products as it has words."""
    target = vectors.select("run_id", F.col("vector").alias("_page"))
    dot = F.aggregate(
        hashed_entries(F.col("keyword")),
        F.lit(0.0),
        lambda acc, e: acc + e["weight"] * F.element_at("_page", e["bucket"] + 1),
    )
    return (
        phrases.join(target, "run_id")
        .withColumn("fit", half_even(F.greatest(F.lit(0.0), dot), 4))
        .drop("_page")
    )

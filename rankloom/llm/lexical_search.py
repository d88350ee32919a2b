"""Ranked lexical search by dense blocked matrix products.

Items (short queries) are put into tiles; the distinct terms of a tile's items are its compact
vocabulary, cut into tiles of `columns` terms. A tile of documents is a dense matrix of impacts over
those terms, and the product of the items' term weights with it (float64, BLAS) scores every document
of the tile for every item of the tile at once. Weights and impacts are integers, and a vocabulary
tile ends before the largest possible sum would reach 2**53, so that every partial product is exact;
partial sums are added as 64-bit integers.

A task keeps the `k` best rows of each item over all its tiles. The threshold is the k-th best score
so far, and rows equal to it are kept for the comparison by doc_id, so ties never depend on the order
of tiles. The lists of all tasks meet twice: by item and task number modulo `salts`, then by item.

Items go in blocks of at most `block_entries` (item, term) pairs, the size bound of what is broadcast
(16 bytes a pair; a larger item is a block by itself). A benchmark of several blocks takes one pass
over the documents for each. Terms are compared by 64-bit hashes of their bytes.

Null or empty text: no terms; such a document counts nowhere and such an item has no rows. Items that
share an id are one item, their terms together; items without an id are left out. Repeated document
rows are ranked each on its own; rows without a doc_id count in the statistics but aren't ranked.
Extra columns are ignored. No documents or no items: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import cut_lineage, documents, map_batches
from rankloom.llm.decontamination import lowered_words
from rankloom.llm.text_arrays import U, pieces, span_hashes

K = 20
ITEM_TILE = 256
DOC_TILE = 1024
COLUMNS = 2048
BLOCK_ENTRIES = 2_000_000
SALTS = 64
IMPACT = 1_000_000  # no impact reaches it: 10**9 * tf div (1000 * tf + 12 * m) with m >= 75
EXACT = 1 << 53

ENTRIES = "item_id long, term long, q long"
FOUND = "item_id long, doc_id long, score long"


def lexical_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    item_col: str = "item_id",
    text_col: str = "text",
    block_entries: int = BLOCK_ENTRIES,
    columns: int = COLUMNS,
    doc_tile: int = DOC_TILE,
    item_tile: int = ITEM_TILE,
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the `k` best documents with a score above 0 of each item."""
    texts = documents(docs)
    entries = cut_lineage(item_terms(items, item_col, text_col))
    found: list[DataFrame] = []
    for block in _blocks(entries, block_entries):
        plan = entries.filter(F.col("item_id").between(*block)).toPandas().sort_values(["item_id", "term"])
        item, term, q = (plan[name].to_numpy() for name in ("item_id", "term", "q"))
        vocabulary = np.unique(term.view(U))
        stats = corpus_statistics(texts, vocabulary)
        tiles = build_tiles(item, term.view(U), q, vocabulary, stats, columns, item_tile)
        held = docs.sparkSession.sparkContext.broadcast((vocabulary, stats, tiles))
        found.append(texts.filter("doc_id IS NOT NULL").mapInArrow(_best_rows(held, k, doc_tile), FOUND))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    best = [F.col("score").desc(), F.col("doc_id").asc()]
    salted = rows.withColumn("salt", F.spark_partition_id() % SALTS)
    near = Window.partitionBy("item_id", "salt").orderBy(*best)
    few = salted.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)
    last = Window.partitionBy("item_id").orderBy(*best)
    ranked = few.drop("salt").withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, term, q): how often an item holds a term."""
    named = items.select(
        items[f"`{item_col}`"].cast("long").alias("item_id"),
        F.coalesce(items[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"),
    ).filter("item_id IS NOT NULL")

    def step(batch: pa.RecordBatch):
        ids = batch.column("item_id").to_numpy()
        for lo, hi, data, offsets in pieces(batch.column("text")):
            words = lowered_words(data, offsets)
            term = span_hashes(words.data, words.starts, words.ends)
            yield {"item_id": np.repeat(ids[lo:hi], words.counts), "term": term, "q": np.ones(len(term), np.int64)}

    return map_batches(named, step, ENTRIES).groupBy("item_id", "term").agg(F.sum("q").alias("q"))


def _blocks(entries: DataFrame, limit: int) -> list[tuple[int, int]]:
    """Ranges of item ids, both ends included, with at most `limit` entries each."""
    low, high, total = entries.agg(F.min("item_id"), F.max("item_id"), F.count("*")).first()
    if total <= limit:
        return [(low, high)] if total else []
    sizes = entries.groupBy("item_id").count().orderBy("item_id").toLocalIterator()
    blocks: list[tuple[int, int]] = []
    first = last = None
    held = 0
    for item, many in sizes:
        if first is not None and held + many > limit:
            blocks.append((first, last))
            first, held = None, 0
        first = item if first is None else first
        last, held = item, held + many
    return blocks if first is None else [*blocks, (first, last)]


@dataclass
class Statistics:
    n_docs: int  # documents with a term
    n_terms: int
    df: np.ndarray  # documents that hold a term of the vocabulary


def corpus_statistics(texts: DataFrame, vocabulary: np.ndarray) -> Statistics:
    """Counts over all documents; tasks add up their own, the driver sees a row per vocabulary term."""
    held = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        df, n_docs, n_terms = np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column("text")):
                doc, term, _, sizes = _postings(data, offsets, known)
                df += np.bincount(term, minlength=len(known))
                n_docs += int(np.count_nonzero(sizes))
                n_terms += int(sizes.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({
            "term": pa.array(np.concatenate([[-1, -2], seen]), pa.int64()),
            "n": pa.array(np.concatenate([[n_docs, n_terms], df[seen]]), pa.int64()),
        })

    df, totals = np.zeros(len(vocabulary), np.int64), {-1: 0, -2: 0}
    counted = texts.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n"))
    for term, n in counted.collect():
        if term < 0:
            totals[term] = n
        else:
            df[term] = n
    return Statistics(totals[-1], totals[-2], df)


def _postings(data, offsets, vocabulary):
    """(document, vocabulary place, occurrences) of a piece, and each document's number of terms."""
    words = lowered_words(data, offsets)
    hashes = span_hashes(words.data, words.starts, words.ends)
    at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
    same = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
    pair, tf = np.unique(words.doc_of()[same] * len(vocabulary) + at[same], return_counts=True)
    doc, term = np.divmod(pair, max(len(vocabulary), 1))
    return doc, term, tf, words.counts


def weight(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, stats: Statistics) -> np.ndarray:
    """Impact of a term with tf occurrences in a document of n terms, in integers."""
    if len(n) and 25 * int(n.max()) * stats.n_docs >= 1 << 63:
        n = n.astype(object)
    m = (75 + (25 * n * stats.n_docs) // max(stats.n_terms, 1)).astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


@dataclass
class Part:
    """A vocabulary tile: its terms, and the weights of the items' terms in it."""

    terms: np.ndarray  # places in the vocabulary
    row: np.ndarray
    column: np.ndarray
    worth: np.ndarray


@dataclass
class Tile:
    items: np.ndarray  # ids
    parts: list[Part]


def build_tiles(item, term, q, vocabulary, stats: Statistics, columns: int, item_tile: int) -> list[Tile]:
    """Tiles of items with their compact vocabularies; entries come sorted by item. The weights of one
    vocabulary tile add up, for any item, to less than 2**53 / IMPACT: a weight beyond that is split."""
    place = np.searchsorted(vocabulary, term)
    worth = weight(stats.n_docs, stats.df)[place] * q
    ids, row = np.unique(item, return_inverse=True)
    limit = EXACT // IMPACT - 1
    tiles = []
    for lo in range(0, len(ids), item_tile):
        a, b = np.searchsorted(row, [lo, lo + item_tile])
        parts, rows, used, left = [], row[a:b] - lo, place[a:b], worth[a:b]
        while len(left):
            now = np.minimum(left, limit)
            parts += _parts(rows, used, now, columns, limit)
            more = left > now
            rows, used, left = rows[more], used[more], (left - now)[more]
        tiles.append(Tile(ids[lo : lo + item_tile], parts))
    return tiles


def _parts(row, place, worth, columns: int, limit: int) -> list[Part]:
    terms, column = np.unique(place, return_inverse=True)
    most = np.zeros(len(terms), np.int64)
    np.maximum.at(most, column, worth)
    parts, start = [], 0
    while start < len(terms):
        end = start + int(np.searchsorted(np.cumsum(most[start : start + columns]), limit, "right"))
        inside = (column >= start) & (column < end)
        parts.append(Part(terms[start:end], row[inside], column[inside] - start, worth[inside]))
        start = end
    return parts


def tile_scores(tile: Tile, doc, term, impact, n_docs: int, vocabulary_size: int) -> np.ndarray:
    """Scores of a tile's items (rows) for the documents 0 to n_docs - 1 (columns)."""
    total = np.zeros((len(tile.items), n_docs), np.int64)
    for part in tile.parts:
        where = np.full(vocabulary_size, -1)
        where[part.terms] = np.arange(len(part.terms))
        column = where[term]
        inside = column >= 0
        dense = np.zeros((len(part.terms), n_docs))
        dense[column[inside], doc[inside]] = impact[inside]
        weights = np.zeros((len(tile.items), len(part.terms)))
        weights[part.row, part.column] = part.worth
        total += (weights @ dense).astype(np.int64)
    return total


class TopK:
    """The k best (score, doc_id) of each item of a tile, rows of later tiles coming in lots."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.item, self.doc, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if scores.shape[1] > self.k:  # the lot's own k-th best score bounds what can stay
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k]
            self.least = np.maximum(self.least, kth)
        item, column = np.nonzero(scores >= self.least[:, None])
        if not len(item):
            return
        item = np.concatenate([self.item, item])
        doc = np.concatenate([self.doc, ids[column]])
        score = np.concatenate([self.score, scores[item[len(self.item) :], column]])
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        stays = place < self.k
        last = place == self.k - 1
        self.least[item[last]] = score[last]
        self.item, self.doc, self.score = item[stays], doc[stays], score[stays]


def _best_rows(held, k: int, doc_tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, stats, tiles = held.value
        best = [TopK(len(t.items), k) for t in tiles]
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for lo, hi, data, offsets in pieces(batch.column("text")):
                doc, term, tf, sizes = _postings(data, offsets, vocabulary)
                impact = impacts(tf, sizes[doc], stats)
                for at in range(0, hi - lo, doc_tile):
                    many = min(doc_tile, hi - lo - at)
                    a, b = np.searchsorted(doc, [at, at + many])
                    for tile, top in zip(tiles, best, strict=True):
                        scores = tile_scores(tile, doc[a:b] - at, term[a:b], impact[a:b], many, len(vocabulary))
                        top.add(ids[lo + at : lo + at + many], scores)
        for tile, top in zip(tiles, best, strict=True):
            columns = (tile.items[top.item], top.doc, top.score)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    return run

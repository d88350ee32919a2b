"""Benchmark decontamination as a prefix-filtered join with exact containment.

Every benchmark item is cut into windows of `window` words (an item of fewer words is one window).
A window's words are ordered by rarity, counted over all documents, and its rarest word is the
only prefix token it needs, since containment of the whole window is asked for. A document word
equal to a prefix token proposes the windows that hold it; the position of the token in the window
and the lengths of both bound where the window could lie, and the words there are compared one by
one. No document is shuffled.

The index of a block of benchmark items is broadcast. Blocks hold at most `block_words` words, so
the broadcast has a size bound whatever the benchmark's size; a larger benchmark takes several
passes over the documents, and their hits are merged by document.

Null or empty text or item: no words, no hit. An item without an id is left out. Items that share
an id count as one item; repeated document rows are answered each on its own. Extra columns are
ignored. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import cut_lineage, documents, lists, map_batches
from rankloom.llm.text_arrays import ALNUM_OR_WIDE, LOWER, Words, pieces, span_hashes, split_words

WINDOW = 10
BLOCK_WORDS = 2_000_000  # about 100 MB of index in a worker

HITS = "doc_id long, tag long, n_words long, hit_words array<int>, items array<string>"


def lowered_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return split_words(LOWER[data], offsets, ALNUM_OR_WIDE)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    item_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, hit_words (positions from 0), items (ids whose windows
    occur, sorted as strings), contaminated, and tag (xxhash64 of the text), which tells rows apart
    that share a doc_id or have none."""
    texts = documents(docs).withColumn("tag", F.xxhash64("text"))
    suite = items.select(
        items[f"`{item_col}`"].cast("string").alias("item"),
        F.coalesce(items[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"),
    ).filter("item IS NOT NULL")
    size = suite.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * block_words)))  # a word and its gap take two characters at least
    sc = docs.sparkSession.sparkContext
    found: list[DataFrame] = []
    for block in range(blocks):
        part = suite.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        vocabulary, windows = _windows(part, window)
        counts = _counts(texts, sc.broadcast(vocabulary), len(vocabulary))
        held = sc.broadcast(Index.build(windows, vocabulary, counts))
        hits = _hits(texts, held, everything=block == 0)
        if blocks > 1:
            hits = cut_lineage(hits)
            held.unpersist()
        found.append(hits)
    merged = found[0]
    if blocks > 1:
        for more in found[1:]:
            merged = merged.unionByName(more)
        once = merged.groupBy("doc_id", "tag").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        rows = found[0].select(F.col("doc_id").alias("row_id"), F.col("tag").alias("row_tag"), "n_words")
        same = F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("tag") == F.col("row_tag"))
        merged = rows.join(once, same)
    return merged.select(
        "doc_id", "n_words", "hit_words", "items", (F.size("hit_words") > 0).alias("contaminated"), "tag"
    )


def _windows(part: DataFrame, window: int) -> tuple[np.ndarray, list[tuple[np.ndarray, list[str]]]]:
    """The block's sorted word hashes and its distinct windows (word hashes, item ids)."""
    found: dict[bytes, list[str]] = {}
    vocabulary: set[int] = set()
    for row in part.distinct().orderBy("item", "text").toLocalIterator():
        raw = np.frombuffer(row["text"].encode(), np.uint8)
        words = lowered_words(raw, np.array([0, len(raw)]))
        hashes = span_hashes(words.data, words.starts, words.ends)
        vocabulary.update(hashes.tolist())
        for at in range(max(1, len(hashes) - window + 1) if len(hashes) else 0):
            owners = found.setdefault(hashes[at : at + window].tobytes(), [])
            if not owners or owners[-1] != row["item"]:
                owners.append(row["item"])
    listed = np.array(sorted(vocabulary), np.uint64)
    return listed, [(np.frombuffer(k, np.uint64), v) for k, v in found.items()]


def _counts(texts: DataFrame, held, size: int) -> np.ndarray:
    """How often each vocabulary word occurs in all documents."""

    def step(batch: pa.RecordBatch):
        known, total = held.value, np.zeros(size, np.int64)
        if size:
            for _, _, data, offsets in pieces(batch.column("text")):
                words = lowered_words(data, offsets)
                at, same = _look_up(known, span_hashes(words.data, words.starts, words.ends))
                total += np.bincount(at[same], minlength=size)
        seen = np.flatnonzero(total)
        return {"word": seen, "n": total[seen]}

    counts = np.zeros(size, np.int64)
    for word, n in map_batches(texts.select("text"), step, "word int, n long").groupBy("word").agg(F.sum("n")).collect():
        counts[word] = n  # at most one row per word of the block
    return counts


def _look_up(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return at, known[at] == asked


@dataclass
class Index:
    prefixes: np.ndarray  # sorted hashes of prefix tokens
    first: np.ndarray  # entries of prefix p: first[p] to first[p + 1]
    entry_window: np.ndarray
    entry_offset: np.ndarray  # place of the token in the window
    lengths: np.ndarray
    words: np.ndarray  # word hashes, one row per window, zero beyond its length
    items: list[list[str]]

    @classmethod
    def build(cls, windows, vocabulary: np.ndarray, counts: np.ndarray) -> Index:
        width = max((len(w) for w, _ in windows), default=1)
        grid = np.zeros((len(windows), width), np.uint64)
        lengths = np.array([len(w) for w, _ in windows], np.int64)
        offsets = np.zeros(len(windows), np.int64)
        for i, (hashes, _) in enumerate(windows):
            grid[i, : len(hashes)] = hashes
            rarity = counts[np.searchsorted(vocabulary, hashes)]
            offsets[i] = np.lexsort((hashes, rarity))[0]
        tokens = grid[np.arange(len(windows)), offsets]
        order = np.argsort(tokens, kind="stable")
        prefixes, first = np.unique(tokens[order], return_index=True)
        return cls(
            prefixes, np.append(first, len(order)), order, offsets[order], lengths, grid, [v for _, v in windows]
        )

    def match(self, hashes: np.ndarray, first_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start word, window) of every occurrence inside one document."""
        if not len(self.prefixes) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, same = _look_up(self.prefixes, hashes)
        place, token = np.flatnonzero(same), at[same]
        many = self.first[token + 1] - self.first[token]
        entry = np.repeat(self.first[token], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start = np.repeat(place, many) - self.entry_offset[entry]
        window = self.entry_window[entry]
        doc = np.searchsorted(first_word, np.repeat(place, many), "right") - 1
        fits = (start >= first_word[doc]) & (start + self.lengths[window] <= first_word[doc + 1])
        start, window = start[fits], window[fits]
        for j in range(self.words.shape[1]):
            inside = j < self.lengths[window]
            there = hashes[np.minimum(start + j, len(hashes) - 1)]
            fine = ~inside | (there == self.words[window, j])
            start, window = start[fine], window[fine]
        return start, window


def _hits(texts: DataFrame, held, everything: bool) -> DataFrame:
    def step(batch: pa.RecordBatch):
        index = held.value
        for lo, hi, data, offsets in pieces(batch.column("text")):
            words = lowered_words(data, offsets)
            start, window = index.match(span_hashes(words.data, words.starts, words.ends), words.first)
            covered = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(covered, start, 1)
            np.add.at(covered, start + index.lengths[window], -1)
            hit = np.flatnonzero(np.cumsum(covered)[:-1] > 0)
            hit_doc = np.searchsorted(words.first, hit, "right") - 1
            named: list[set[str]] = [set() for _ in range(hi - lo)]
            owner = np.searchsorted(words.first, start, "right") - 1
            for d, w in np.unique(np.stack([owner, window], axis=1), axis=0).tolist():
                named[d].update(index.items[w])
            columns = {
                "doc_id": batch.column("doc_id").slice(lo, hi - lo),
                "tag": batch.column("tag").slice(lo, hi - lo),
                "n_words": pa.array(words.counts, pa.int64()),
                "hit_words": lists(hit - words.first[hit_doc], np.bincount(hit_doc, minlength=hi - lo), pa.int32()),
                "items": pa.array([sorted(x) for x in named], pa.list_(pa.string())),
            }
            if not everything:
                some = pa.array([bool(x) for x in named])
                columns = {k: v.filter(some) for k, v in columns.items()}
            yield columns

    return map_batches(texts, step, HITS)

"""Where texts repeat: content-defined anchors and what equal surroundings say about windows.

A window is `width` consecutive symbols (bytes or words). Its anchor is the place of the smallest
hash among the `gram`-symbol substrings it holds, so equal windows have equal anchors at equal
places, and neighbouring windows mostly share one. The windows of one anchor are neighbours, and the
symbols they span are the anchor's context.

Anchors with equal keys meet. An occurrence whose context equals that of the key's first occurrence
repeats it whole (DUPLICATE). If contexts differ, the windows of the others need a closer look
(CANDIDATE). A key met once says that none of its windows is met twice.

Each Arrow batch of documents settles what it can by itself: copies of a context beyond the first
are duplicates whatever other batches hold, so a passage in a third of all documents sends one
row per batch. A key with more than HOT contexts in a batch (a common passage between different
neighbours) sends one WITNESS row, and its rows become CANDIDATE_HOT in a group of their own. So the
rows of a key that meet are bounded by the number of batches, not of copies.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import documents, map_batches
from rankloom.llm.text_arrays import U, mix, pieces

PENDING, DUPLICATE, CANDIDATE_HOT, WITNESS = 0, 1, 2, 3
CANDIDATE = PENDING  # after the meeting
HOT = 64

# `at` holds a run of windows in one number: first window, how many (below MOST), kind
MOST = 1 << 24
AT = "key long, ctx long, doc_id long, at long"


def packed(start, count, kind):
    return (start << 26) | (count << 2) | kind


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 26, (at >> 2) & (MOST - 1), at & 3


def by_id(docs: DataFrame) -> DataFrame:
    """(doc_id, packed), one row per doc_id: of several rows with one id the smallest packed text
    counts; rows without an id are left out. Packed texts halve what is shuffled, and later joins on
    doc_id use the same exchange."""

    def step(batch: pa.RecordBatch):
        texts = batch.column("text").to_pylist()
        packed_texts = pa.array([zlib.compress(t.encode(), 1) for t in texts], pa.binary())
        return {"doc_id": batch.column("doc_id"), "packed": packed_texts}

    rows = map_batches(documents(docs).filter("doc_id IS NOT NULL"), step, "doc_id long, packed binary")
    # the joins ask for ids that aren't null: said here, the exchange is the same wherever it is used
    return rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("packed").alias("packed"))


def unpacked_texts(column: pa.Array) -> pa.Array:
    return pa.array([zlib.decompress(x) for x in column.to_pylist()], pa.binary()).cast(pa.large_string())


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each `width` consecutive values, the leftmost one of equals."""
    best, place, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left = best[:-step] <= best[step:]
        best = np.where(left, best[:-step], best[step:])
        place = np.where(left, place[:-step], place[step:])
        have += step
    return place


def anchors(grams: np.ndarray, first: np.ndarray, width: int, gram: int):
    """(document, first window, number of windows, anchor place) of every anchor of a piece whose
    symbols of document d are first[d] to first[d + 1]; grams: hash of `gram` symbols at each place."""
    none = np.zeros(0, np.int64)
    if first[-1] < width:
        return none, none, none, none
    owner = sliding_argmin(grams, width - gram + 1)
    n_windows = np.maximum(np.diff(first) - width + 1, 0)
    doc = np.repeat(np.arange(len(n_windows)), n_windows)
    window = np.arange(n_windows.sum()) + np.repeat(first[:-1] - np.cumsum(n_windows) + n_windows, n_windows)
    place = owner[window]
    opens = np.ones(len(window), bool)
    opens[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(opens)
    return doc[run], window[run], np.diff(np.append(run, len(window))), place[run]


def settle(key, ctx, doc, at, across_only: bool):
    """What a batch knows by itself: keys and kinds of its anchors (see the module's text)."""
    if not len(key):
        return key, at
    order = np.lexsort((at, doc, ctx, key))
    key, ctx, doc, at = key[order], ctx[order], doc[order], at[order]
    new_key, new_ctx = np.ones(len(key), bool), np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    new_ctx[1:] = new_key[1:] | (ctx[1:] != ctx[:-1])
    leader = np.maximum.accumulate(np.where(new_ctx, np.arange(len(key)), 0))
    later = ~new_ctx & ((doc > doc[leader]) if across_only else True)
    starts = np.flatnonzero(new_key)
    hot = np.repeat(np.add.reduceat(new_ctx.astype(np.int64), starts) > HOT, np.diff(np.append(starts, len(key))))
    kind = np.where(later, DUPLICATE, np.where(hot, np.where(new_key, WITNESS, CANDIDATE_HOT), PENDING))
    spread = mix(mix(doc.astype(U)) + at.astype(U))
    batch = mix(np.array([spread[0] + U(len(key))], U))
    out = np.where(later, spread, np.where(kind == CANDIDATE_HOT, mix(key ^ batch), key))
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[back], (at + kind)[back]


def anchor_rows(texts: DataFrame, find: Callable, across_only: bool) -> DataFrame:
    """Anchors of all documents (AT), settled within batches. `find(data, offsets)` gives arrays:
    document, first window, number of windows, key, ctx."""

    def step(batch: pa.RecordBatch):
        ids = batch.column("doc_id").to_numpy()
        found = []
        for lo, _, data, offsets in pieces(unpacked_texts(batch.column("packed"))):
            doc, start, count, key, ctx = find(data, offsets)
            found.append((ids[lo + doc], packed(start, count, 0), key, ctx))
        doc, at, key, ctx = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
        key, at = settle(key.view(U), ctx.view(U), doc, at, across_only)
        return {"key": key, "ctx": ctx, "doc_id": doc, "at": at}

    return map_batches(texts, step, AT)


def verdicts(rows: DataFrame, across_only: bool) -> DataFrame:
    """(key, doc_id, at) of the anchors that are not unique, with their kind settled among batches."""
    group = Window.partitionBy("key")
    kind = F.col("at").bitwiseAND(3)
    seen = rows.select(
        "*",
        F.min("ctx").over(group).alias("low"),
        F.max("ctx").over(group).alias("high"),
        F.min(F.struct("doc_id", "at", "ctx")).over(group).alias("first"),
        F.max(kind == WITNESS).over(group).alias("hot"),
    )
    place = F.struct("doc_id", "at", "ctx")
    later = F.col("doc_id") > F.col("first.doc_id") if across_only else place > F.col("first")
    later = later & (F.col("ctx") == F.col("first.ctx"))
    own = F.col("at") - kind
    return (
        seen.select(
            "key",
            "doc_id",
            F.when(kind.isin(DUPLICATE, CANDIDATE_HOT), F.col("at"))
            .when(later, own + DUPLICATE)
            .when(F.col("hot"), own + CANDIDATE_HOT)
            .when(F.col("low") != F.col("high"), own + CANDIDATE)
            .alias("at"),
        )
    ).filter("at IS NOT NULL")


def repeated_windows(rows: DataFrame, across_only: bool) -> DataFrame:
    """(doc_id, at) of windows met before. rows: h1, h2 (hashes of a window's symbols), doc_id, at;
    rows of kind DUPLICATE are passed on."""
    group = Window.partitionBy("h1", "h2")
    first = F.min(F.struct("doc_id", "at")).over(group)
    met = rows.select("*", first.alias("first"))
    later = F.col("doc_id") > F.col("first.doc_id") if across_only else F.struct("doc_id", "at") > F.col("first")
    return met.filter(later | (F.col("at").bitwiseAND(3) == DUPLICATE)).select("doc_id", "at")


def settle_windows(h1, h2, doc, at, across_only: bool):
    """Of window rows: which ones a batch knows to be repeats, by an earlier one of its own."""
    if not len(h1):
        return np.zeros(0, bool)
    order = np.lexsort((at, doc, h2, h1))
    a, b, d = h1[order], h2[order], doc[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    leader = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    out = np.zeros(len(a), bool)
    out[order] = ~new & ((d > d[leader]) if across_only else True)
    return out


def runs(doc: np.ndarray, start: np.ndarray, count: np.ndarray | int = 1) -> tuple[np.ndarray, np.ndarray]:
    """DUPLICATE rows (doc, at) for the runs of windows of documents, neighbouring runs in one."""
    count = np.broadcast_to(np.asarray(count, np.int64), start.shape)
    order = np.lexsort((start, doc))
    doc, start, count = doc[order], start[order], count[order]
    opens = np.ones(len(doc), bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + count[:-1])
    first = np.flatnonzero(opens)
    total = np.add.reduceat(count, first) if len(first) else count
    parts = -(-total // (MOST - 1))
    doc, start, total = (np.repeat(x, parts) for x in (doc[first], start[first], total))
    done = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * (MOST - 1)
    return doc, packed(start + done, np.minimum(total - done, MOST - 1), DUPLICATE)


def covered(size: int, at: np.ndarray, width: int) -> np.ndarray:
    """Which of a document's symbols the windows of `at` cover; a window beyond its end covers none."""
    start, count, _ = unpacked(at)
    fits = start + count + width - 1 <= size
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start[fits], 1)
    np.add.at(edge, (start + count + width - 1)[fits], -1)
    return np.cumsum(edge[:-1]) > 0


def with_spans(texts: DataFrame, spans: DataFrame, value: Column, keep_all: bool) -> DataFrame:
    """Documents with the list of their spans; with `keep_all` also those that have none."""
    listed = spans.groupBy(F.col("doc_id").alias("span_doc")).agg(F.collect_list(value).alias("spans"))
    joined = texts.join(listed, F.col("doc_id") == F.col("span_doc"), "left" if keep_all else "inner")
    return joined.select("doc_id", "packed", "spans")

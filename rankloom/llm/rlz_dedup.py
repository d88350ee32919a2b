"""Substring de-duplication by relative Lempel-Ziv parsing against the rest of the corpus.

Reference blocks are the stretches of words around content-defined anchors (see anchors), and every
block of every document is indexed under its anchor's hash, so equal windows of `width` words meet in
one group. Blocks equal to the first of their group are settled whole. The others send their words to
the group, where each is parsed greedily from left to right against all blocks of documents with
smaller ids: at a window, the longest match with any of them is taken as a factor (see factors). A
factor of `width` words or more is a duplicate span, and the parse goes on with the first window beyond
it; so windows are looked at only at factor boundaries, and where no factor starts. Where a group is
larger than what is parsed at once or was split over batches, windows without a factor meet once more
by the hash of their words.

So the result is exact: a word is removed if and only if a window over it also starts in a document
with a smaller doc_id (words by 64-bit hashes, compared one after the other).

Null or empty text: no words. Of several rows with one doc_id one counts (the one whose packed text is
smallest); rows without a doc_id are left out. Extra columns are ignored. No documents: no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import anchors as A
from rankloom.llm.common import map_batches
from rankloom.llm.factors import in_blocks, longest_earlier, prefix_ranks
from rankloom.llm.text_arrays import NOT_SPACE, U, gram_hashes, mix, pieces, powers, span_hashes, split_words

WIDTH = 13
GRAM = 5
BLOCK_BYTES = 2 << 20

CONTEXTS = "key long, doc_id long, at long, context binary"
WINDOWS = "h1 long, h2 long, doc_id long, at long"


def substring_dedup(
    docs: DataFrame, width: int = WIDTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, texts: bool = False
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one
    space, and with `texts` also kept_text."""
    source = A.by_id(docs)
    known = A.verdicts(A.anchor_rows(source, _finder(width, gram), True), True)
    contexts = map_batches(A.with_spans(source, known, F.struct("at", "key"), keep_all=False), _contexts(width), CONTEXTS)
    grouped = contexts.repartition("key").sortWithinPartitions("key", "doc_id", "at")
    windows = grouped.mapInArrow(in_blocks(block_bytes, partial(windows_of, width=width)), WINDOWS)
    repeats = A.repeated_windows(windows, True)
    return _cut(A.with_spans(source, repeats, F.col("at"), keep_all=True), width, texts)


def _word_hashes(data, offsets, lane=0):
    words = split_words(data, offsets, NOT_SPACE)
    return words, span_hashes(data, words.starts, words.ends, lane)


def _finder(width: int, gram: int):
    def find(data, offsets):
        words, hashes = _word_hashes(data, offsets)
        doc, start, count, place = A.anchors(gram_hashes(hashes, gram), words.first, width, gram)
        power, inverse = powers(1, len(hashes) + 1)
        prefix = np.concatenate([np.zeros(1, U), np.cumsum(hashes * power[: len(hashes)], dtype=U)])
        ctx = mix((prefix[start + count + width - 1] - prefix[start]) * inverse[start])
        ctx = mix(ctx + count.astype(U) * U(1 << 32) + (place - start).astype(U))
        grams = gram_hashes(hashes, gram)
        return doc, start - words.first[doc], count, grams[place], ctx

    return find


def _contexts(width: int):
    """Settled duplicates as they are; the word hashes that a candidate's windows span."""

    def step(batch: pa.RecordBatch):
        ids = batch.column("doc_id").to_numpy()
        for lo, hi, data, offsets in pieces(A.unpacked_texts(batch.column("packed"))):
            spans = batch.column("spans").slice(lo, hi - lo)
            flat = spans.flatten()
            at, key = (flat.field(n).to_numpy() for n in ("at", "key"))
            doc = np.repeat(np.arange(hi - lo), spans.value_lengths().to_numpy())
            start, count, kind = A.unpacked(at)
            settled = kind == A.DUPLICATE
            done, run = A.runs(ids[lo + doc[settled]], start[settled], count[settled])
            doc, start, count, at, key = (x[~settled] for x in (doc, start, count, at, key))
            words, hashes = _word_hashes(data, offsets)
            where, raw = 8 * (words.first[doc] + start), hashes.tobytes()
            ends = where + 8 * (count + width - 1)
            context = [raw[a:b] for a, b in zip(where.tolist(), ends.tolist(), strict=True)]
            spread = mix(mix(done.astype(U)) + run.astype(U)).view(np.int64)
            yield {
                "key": np.concatenate([spread, key]),
                "doc_id": np.concatenate([done, ids[lo + doc]]),
                "at": np.concatenate([run, at]),
                "context": pa.array([None] * len(done) + context, pa.binary()),
            }

    return step


def windows_of(rows: pa.Table, split: int | None, width: int) -> pa.RecordBatch:
    """Duplicate runs of a block, and hashes of the windows that other blocks may have earlier."""
    key, doc, at = (rows.column(n).to_numpy() for n in ("key", "doc_id", "at"))
    start, count, kind = A.unpacked(at)
    settled = kind == A.DUPLICATE
    order = np.flatnonzero(~settled)
    raw = rows.column("context").combine_chunks().take(pa.array(order))
    lengths = np.array([len(x) // 8 for x in raw.to_pylist()], np.int64)
    words = np.frombuffer(b"".join(raw.to_pylist()), U)
    begin = np.cumsum(lengths) - lengths
    many = count[order]
    inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    suffix = np.repeat(begin, many) + inner
    owner, window = np.repeat(doc[order], many), np.repeat(start[order], many) + inner
    shared = np.repeat((kind[order] == A.CANDIDATE_HOT) | (key[order] == split if split is not None else False), many)
    factor = longest_factors(words, begin, lengths, suffix, owner)
    first, reach = parse(factor, np.cumsum(many) - many, many, width)
    done, run = A.runs(owner[first], window[first], reach)
    covered = np.zeros(len(suffix) + 1, np.int64)
    np.add.at(covered, first, 1)
    np.add.at(covered, first + reach, -1)
    ask = (np.cumsum(covered[:-1]) == 0) & shared
    done, run = np.concatenate([doc[settled], done]), np.concatenate([at[settled], run])
    h1, h2 = (gram_hashes(words, width, lane)[suffix[ask]] for lane in (0, 1))
    spread = mix(mix(done.astype(U)) + run.astype(U))
    columns = (
        np.concatenate([spread, h1]).view(np.int64),
        np.concatenate([np.zeros(len(done), U), h2]).view(np.int64),
        np.concatenate([done, owner[ask]]),
        np.concatenate([run, A.packed(window[ask], 1, A.CANDIDATE)]),
    )
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h1", "h2", "doc_id", "at"])


def longest_factors(words, begin, lengths, suffix, owner) -> np.ndarray:
    """The longest match of each place of `suffix` with a place of a document with a smaller id, inside
    the stretches of words that start at `begin`."""
    if not len(suffix):
        return np.zeros(0, np.int64)
    # a smallest symbol behind every stretch, so that no match runs on into the next one
    shift = np.repeat(np.arange(len(begin)), lengths)
    symbols = np.zeros(len(words) + len(begin), U)
    symbols[np.arange(len(words)) + shift] = np.unique(words, return_inverse=True)[1].astype(U) + U(1)
    stretch = np.searchsorted(begin, suffix, "right") - 1
    room = begin[stretch] + lengths[stretch] - suffix
    levels = prefix_ranks(symbols, 1, int(lengths.max()))
    return longest_earlier(levels, suffix + stretch, owner, room)


def parse(factor: np.ndarray, begin: np.ndarray, many: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy parse of stretches of windows (from `begin`, `many` each): (window where a factor starts,
    windows it covers), all stretches a step at a time."""
    opens = np.append(np.flatnonzero(factor >= width), len(factor))
    at, end = begin.copy(), begin + many
    starts, reaches = [], []
    while len(at):
        at = opens[np.searchsorted(opens, at)]  # the next window with a factor
        inside = at < end
        at, end = at[inside], end[inside]
        reach = factor[at] - width + 1
        starts.append(at)
        reaches.append(reach)
        at = at + reach
    return np.concatenate([*starts, np.zeros(0, np.int64)]), np.concatenate([*reaches, np.zeros(0, np.int64)])


def _cut(joined: DataFrame, width: int, texts: bool) -> DataFrame:
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else "")

    def step(batch: pa.RecordBatch):
        spans = batch.column("spans")
        n_words, n_removed, digests, kept_texts = [], [], [], []
        for i, packed in enumerate(batch.column("packed").to_pylist()):
            words = zlib.decompress(packed).split()  # bytes.split() cuts at \x20 and \x09-\x0D
            n_words.append(len(words))
            if spans[i].is_valid:
                gone = A.covered(len(words), spans[i].values.to_numpy(), width)
                words = list(compress(words, (~gone).tolist()))
            n_removed.append(n_words[-1] - len(words))
            kept = b" ".join(words)
            digests.append(hashlib.sha256(kept).hexdigest())
            if texts:
                kept_texts.append(kept.decode())
        return {
            "doc_id": batch.column("doc_id"), "n_words": n_words, "n_removed": n_removed,
            "kept_sha256": digests, "kept_text": kept_texts,
        }

    return map_batches(joined, step, schema)

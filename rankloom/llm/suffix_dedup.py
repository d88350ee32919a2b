"""Exact substring de-duplication by longest-previous-factor arrays.

Every `width`-byte string that also starts earlier (in a document with a smaller id, or before in the
same document) has its bytes removed; the first copy stays. Texts are UTF-8 bytes.

Anchors (see anchors) find where texts can repeat at all, and repeated surroundings are settled whole.
The other candidates send the bytes around their anchor to the anchor's group. There, blocks of
bounded size are put in suffix order by prefix doubling. The previous and the next smaller position in
that order give each suffix its longest previous factor (see factors), and the windows whose factor
reaches `width` bytes are later copies. Where a key's group is larger than a block
or was split over batches, each block keeps its first copies, and those meet once more by the hash of
their bytes.

Null or empty text: no bytes. Of several rows with one doc_id one counts (the one whose packed text is
smallest); rows without a doc_id are left out. Extra columns are ignored. No documents: no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import anchors as A
from rankloom.llm.common import map_batches
from rankloom.llm.factors import in_blocks, longest_earlier, prefix_ranks
from rankloom.llm.text_arrays import U, mix, pieces, powers, span_hashes

WIDTH = 100
GRAM = 20
BLOCK_BYTES = 2 << 20

CONTEXTS = "key long, doc_id long, at long, context binary"
WINDOWS = "h1 long, h2 long, doc_id long, at long"


def suffix_dedup(
    docs: DataFrame, width: int = WIDTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, texts: bool = False
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256,
    and with `texts` also kept (binary: a removed run may cut a character)."""
    source = A.by_id(docs)
    known = A.verdicts(A.anchor_rows(source, _finder(width, gram), False), False)
    contexts = map_batches(
        A.with_spans(source, known, F.struct("at", "key"), keep_all=False), _contexts(width), CONTEXTS
    )
    grouped = contexts.repartition("key").sortWithinPartitions("key", "doc_id", "at")
    windows = grouped.mapInArrow(in_blocks(block_bytes, partial(windows_of, width=width)), WINDOWS)
    repeats = A.repeated_windows(windows, False)
    return _cut(A.with_spans(source, repeats, F.col("at"), keep_all=True), width, texts)


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = powers(0, len(data) + 1)
    prefix = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=prefix[1:])
    return prefix, inverse


def _finder(width: int, gram: int):
    def find(data, offsets):
        if len(data) < width:
            none = np.zeros(0, np.int64)
            return none, none, none, none.view(U), none.view(U)
        prefix, inverse = _prefix(data)
        grams = mix((prefix[gram:] - prefix[:-gram]) * inverse[: len(data) - gram + 1])
        doc, start, count, place = A.anchors(grams, offsets, width, gram)
        ctx = mix((prefix[start + count + width - 1] - prefix[start]) * inverse[start])
        ctx = mix(ctx + count.astype(U) * U(1 << 32) + (place - start).astype(U))
        return doc, start - offsets[doc], count, grams[place], ctx

    return find


def _contexts(width: int):
    """Settled duplicates as they are; the bytes that a candidate's windows span."""

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
            where, raw = offsets[doc] + start, data.tobytes()
            context = [raw[a:b] for a, b in zip(where.tolist(), (where + count + width - 1).tolist(), strict=True)]
            spread = mix(mix(done.astype(U)) + run.astype(U)).view(np.int64)
            yield {
                "key": np.concatenate([spread, key]),
                "doc_id": np.concatenate([done, ids[lo + doc]]),
                "at": np.concatenate([run, at]),
                "context": pa.array([None] * len(done) + context, pa.binary()),
            }

    return step


def windows_of(rows: pa.Table, split: int | None, width: int) -> pa.RecordBatch:
    """Duplicate runs of a block, and hashes of the first copies that other blocks may have earlier."""
    key, doc, at = (rows.column(n).to_numpy() for n in ("key", "doc_id", "at"))
    start, count, kind = A.unpacked(at)
    settled = kind == A.DUPLICATE
    order = np.flatnonzero(~settled)
    order = order[np.lexsort((start[order], doc[order]))]
    column = rows.column("context").combine_chunks()
    context = column.take(pa.array(order)) if len(order) else column.slice(0, 0)
    context = context.combine_chunks() if isinstance(context, pa.ChunkedArray) else context
    raw = context.buffers()
    offsets = np.frombuffer(raw[1], np.int32)[context.offset : context.offset + len(context) + 1].astype(np.int64) if len(context) else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]] if len(context) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    many = count[order]
    inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    suffix = np.repeat(offsets[:-1], many) + inner
    owner, window = np.repeat(doc[order], many), np.repeat(start[order], many) + inner
    shared = np.repeat((kind[order] == A.CANDIDATE_HOT) | (key[order] == split if split is not None else False), many)
    again = longest_previous_factor(data, suffix, width) >= width
    done, run = A.runs(owner[again], window[again])
    done, run = np.concatenate([doc[settled], done]), np.concatenate([at[settled], run])
    ask = ~again & shared
    begin = suffix[ask]
    h1, h2 = (span_hashes(data, begin, begin + width, lane) for lane in (0, 1))
    spread = mix(mix(done.astype(U)) + run.astype(U))
    columns = (
        np.concatenate([spread, h1]).view(np.int64),
        np.concatenate([np.zeros(len(done), U), h2]).view(np.int64),
        np.concatenate([done, owner[ask]]),
        np.concatenate([run, A.packed(window[ask], 1, A.CANDIDATE)]),
    )
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h1", "h2", "doc_id", "at"])


def longest_previous_factor(data: np.ndarray, suffix: np.ndarray, width: int) -> np.ndarray:
    """For each position of `suffix`, which is in text order and has `width` bytes, the length of the
    longest string there that also starts at an earlier position of `suffix`, at most `width`."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.zeros(len(data), U)
    for j in range(8):
        eight = (eight << U(8)) | padded[j : len(data) + j].astype(U)

    def finish(a, b, shared):
        """Bytes shared beyond whole groups of eight."""
        at, to = np.minimum(a + shared, len(data) - 1), np.minimum(b + shared, len(data) - 1)
        apart = eight[at] ^ eight[to]
        more = sum(((apart >> U(8 * (7 - j))) == 0).astype(np.int64) for j in range(7))
        return shared + more

    levels = prefix_ranks(eight, 8, width)
    room = np.full(len(suffix), width, np.int64)
    return longest_earlier(levels, suffix, np.arange(len(suffix)), room, finish)


def _cut(joined: DataFrame, width: int, texts: bool) -> DataFrame:
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept binary" if texts else ""

    def step(batch: pa.RecordBatch):
        spans = batch.column("spans")
        rows = []
        for i, packed in enumerate(batch.column("packed").to_pylist()):
            raw = zlib.decompress(packed)
            kept, n_spans = raw, 0
            if spans[i].is_valid:
                gone = A.covered(len(raw), spans[i].values.to_numpy(), width)
                n_spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            rows.append((len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept))
        names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
        return {"doc_id": batch.column("doc_id")} | dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    return map_batches(joined, step, schema)

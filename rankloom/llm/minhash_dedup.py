"""Near-duplicate documents by MinHash with sequential Bayesian verification.

1. Each document's set of `shingle`-word shingles gives a MinHash signature. Documents with equal sets
   form one class, which goes on as its smallest doc_id.
2. Bands of the signature put classes into buckets. In a bucket, members are compared with a few hubs
   instead of with each other. Members that the hubs leave apart are compared with every member that
   is in another component, exactly at once and between blocks of members, so that no row is made
   for a pair. Every candidate pair is either compared or already connected.
3. A pair's signatures are compared in batches. After each batch the posterior probability that the
   similarity reaches the threshold, given the matches so far and a uniform prior, must be at
   least `miss`; else the pair is dropped. Survivors are verified on their full sets.
4. Links connect classes; a component's documents are near duplicates, its smallest doc_id is kept.

Null or empty text: no shingles, no links. Fewer words than a shingle: the whole sequence is the only
shingle. Of several rows with one doc_id one counts (the one with the smallest set hash); rows without
a doc_id are left out. Extra columns are ignored. No documents: no rows.
"""

from __future__ import annotations

from functools import partial
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import cut_lineage, documents, map_batches
from rankloom.llm.components import components
from rankloom.llm.text_arrays import LOWER, NOT_SPACE, U, gram_hashes, mix, pieces, span_hashes, split_words

SHINGLE = 5
PERCENT = 85  # similarity at which two documents are linked
HASHES, BATCH = 128, 32
BAND_MISS = 1e-5  # a pair at the threshold shares no band with at most this probability
MISS = 1e-6
HUBS = 4
BLOCK = 256


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows) of the signature: the longest rows for which enough bands fit in HASHES values.
    Below 9 percent no number of bands is enough, and every value is a band of its own."""
    for rows in range(HASHES, 0, -1):
        apart = 1 - (percent / 100) ** rows  # a band of a pair at the threshold differs
        bands = ceil(log(BAND_MISS) / log(apart)) if 0 < apart < 1 else 1 if apart == 0 else HASHES + 1
        if bands * rows <= HASHES:
            return bands, rows
    return HASHES, 1


BANDS, ROWS = banding(PERCENT)
_FACTORS = mix(np.arange(1, HASHES + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest doc_id with the same set),
    component_id (smallest doc_id reachable over links), kept (doc_id = component_id)."""
    source = documents(docs).filter("doc_id IS NOT NULL")
    signed = cut_lineage(signatures(source, shingle))
    full = signed.filter("n > 0")
    texts = source.withColumn("mark", F.xxhash64("text"))
    classes = full.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("class_id"))
    first = cut_lineage(
        full.groupBy("h1", "h2", "n")
        .agg(F.min(F.struct("doc_id", "sig", "mark")).alias("least"))
        .select(F.col("least.doc_id").alias("id"), "n", F.col("least.sig").alias("sig"), F.col("least.mark").alias("mark"))
    )
    found = components(links(texts, first, shingle, percent))
    members = full.select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2", "n"])
    placed = members.join(found, F.col("class_id") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id")
    )
    alone = signed.filter("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id")
    )
    return placed.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of a piece, sorted by both."""
    words = split_words(data, offsets, NOT_SPACE)
    hashes = span_hashes(LOWER[data], words.starts, words.ends)
    count, doc_of = words.counts, words.doc_of()
    grams = gram_hashes(hashes, shingle)
    whole = np.flatnonzero(doc_of[: len(grams)] == doc_of[shingle - 1 :]) if len(grams) else np.zeros(0, np.int64)
    doc, value = doc_of[whole], grams[whole]
    short = np.flatnonzero((count > 0) & (count < shingle))
    if len(short):
        own = np.zeros(len(short), U)
        for j in range(shingle - 1):
            inside = j < count[short]
            at = np.minimum(words.first[short] + j, len(hashes) - 1)
            own = np.where(inside, mix(own + hashes[at] + U(j + 1)), own)
        doc, value = np.concatenate([doc, short]), np.concatenate([value, own])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def signatures(source: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, h1, h2, sig, mark): size and hashes of each document's set, its MinHash signature, and
    the hash of its text. Of several rows with one doc_id the one with the smallest hashes counts."""

    def step(batch: pa.RecordBatch):
        for lo, hi, data, offsets in pieces(batch.column("text")):
            doc, value = shingle_sets(data, offsets, shingle)
            n = np.bincount(doc, minlength=hi - lo)
            some = np.flatnonzero(n)
            at = np.searchsorted(doc, some)
            sig = np.zeros((hi - lo, HASHES), np.uint32)
            h1, h2 = np.zeros(hi - lo, U), np.zeros(hi - lo, U)
            if len(some):
                for j in range(HASHES):
                    sig[some, j] = np.minimum.reduceat(value * _FACTORS[j], at) >> U(32)
                h1[some] = np.add.reduceat(mix(value), at)
                h2[some] = np.add.reduceat(mix(value ^ _FACTORS[0]), at)
            yield {
                "doc_id": batch.column("doc_id").slice(lo, hi - lo),
                "n": n,
                "h1": h1,
                "h2": h2,
                "sig": pa.array([row.tobytes() if k else b"" for row, k in zip(sig, n, strict=True)], pa.binary()),
                "mark": batch.column("mark").slice(lo, hi - lo),
            }

    marked = source.withColumn("mark", F.xxhash64("text"))
    made = map_batches(marked, step, "doc_id long, n long, h1 long, h2 long, sig binary, mark long")
    one = made.groupBy("doc_id").agg(F.min(F.struct("h1", "h2", "n", "sig", "mark")).alias("s"))
    return one.select("doc_id", "s.n", "s.h1", "s.h2", "s.sig", "s.mark")


def links(source: DataFrame, first: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): verified links that connect every pair of classes which share a bucket and reach the
    threshold, directly or over other links."""
    bands, rows = banding(percent)
    banded = map_batches(first, partial(_bands, bands=bands, rows=rows), "key long, band int, id long, n long")
    shared = banded.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("size")).filter("size > 1")
    buckets = cut_lineage(banded.join(shared, F.col("key") == F.col("k")).drop("k", "size"))
    asked = first.select("id", "mark").join(buckets.select(F.col("id").alias("b")).distinct(), F.col("id") == F.col("b"), "left_semi")
    # the text of the row that counts, once; as a merge join at every size, so that what it costs is
    # known from small tables
    named = source.select("doc_id", F.col("mark").alias("of"), "text")
    met = named.join(asked.hint("merge"), (F.col("doc_id") == F.col("id")) & (F.col("of") == F.col("mark")))
    texts = cut_lineage(met.groupBy("id", "mark").agg(F.min("text").alias("text")).select("id", "text"))

    hub = F.min_by(F.struct("id", "n"), F.xxhash64("id", F.col("band") % HUBS)).alias("hub")
    hubs = buckets.groupBy(F.col("key").alias("k")).agg(hub)
    pairs = _pairs(buckets.join(hubs, F.col("key") == F.col("k")), percent)
    found = cut_lineage(_verified(_likely(pairs, first, percent), texts, shingle, percent))

    apart = cut_lineage(_apart(buckets, found))
    if apart.take(1):
        found = cut_lineage(found.unionByName(_rest(apart, texts, shingle, percent)).distinct())
    return found


def _apart(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their component, the bucket's
    best-linked member and its component."""
    placed = components(found)
    ends = found.select(F.col("a").alias("e")).unionByName(found.select(F.col("b").alias("e")))
    degree = ends.groupBy("e").agg(F.count("*").alias("degree"))
    known = placed.join(degree, F.col("node") == F.col("e")).select("node", "component", "degree")
    rows = buckets.join(known, F.col("id") == F.col("node"), "left").select(
        "key", "id", "n", F.coalesce("component", "id").alias("comp"), F.coalesce("degree", F.lit(0)).alias("degree")
    )
    best = rows.groupBy(F.col("key").alias("k")).agg(
        F.min("comp").alias("low"),
        F.max("comp").alias("high"),
        F.max(F.struct("degree", (-F.col("id")).alias("older"), "id", "n", "comp")).alias("top"),
    ).filter("low <> high").select("k", F.struct("top.id", "top.n").alias("best"), F.col("top.comp").alias("main"))
    return rows.join(best, F.col("key") == F.col("k")).select("key", "id", "n", "comp", "best", "main")


def _rest(apart: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links of the members that are not in the component of their bucket's best-linked member, with
    any member that met the same one.

    Sets are compared exactly, through their differences from the best-linked member's set: two
    members differ by far + far' - 2 * (what their differences share). Left members and all members
    are dealt into blocks of about BLOCK, each pair of blocks is one small group, and a group
    gives no more links than it has members, enough to connect what is linked in it."""
    asked = apart.select("id", "n", "comp", (F.col("comp") != F.col("main")).alias("left_over"), F.col("best.id").alias("h"))
    a = texts.select(F.col("id").alias("ia"), F.col("text").alias("ta"))
    b = texts.select(F.col("id").alias("ib"), F.col("text").alias("tb"))
    joined = asked.distinct().join(a, F.col("id") == F.col("ia")).join(b, F.col("h") == F.col("ib"))

    def differences(batch: pa.RecordBatch):
        left, right = _sets(batch.column("ta"), shingle), _sets(batch.column("tb"), shingle)
        found = [np.setxor1d(x, y, assume_unique=True) for x, y in zip(left, right, strict=True)]
        kept = {c: batch.column(c) for c in ("h", "id", "n", "comp", "left_over")}
        return kept | {"delta": pa.array([x.tobytes() for x in found], pa.binary())}

    members = cut_lineage(map_batches(joined, differences, "h long, id long, n long, comp long, left_over boolean, delta binary"))
    sizes = members.groupBy(F.col("h").alias("of")).agg(F.count_if("left_over").alias("lefts"), F.count("*").alias("every"))
    dealt = members.join(sizes.filter("lefts > 0"), F.col("h") == F.col("of"))
    lefts, every = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("lefts", "every"))
    own = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("int")
    kept = ["h", "id", "n", "comp", "delta"]
    asking = dealt.filter("left_over").select(
        *kept, F.lit(True).alias("asks"), (own % lefts).alias("lb"), F.explode(F.sequence(F.lit(0), every - 1)).alias("mb")
    )
    asked_of = dealt.select(
        *kept, F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), lefts - 1)).alias("lb"), (own % every).alias("mb")
    )
    columns = ["h", "lb", "mb", "asks", "id", "n", "comp", "delta"]
    group = ["h", "lb", "mb"]
    rows = asking.select(columns).unionByName(asked_of.select(columns)).repartition(*group).sortWithinPartitions(*group)
    return rows.mapInArrow(lambda batches: _block_links(batches, percent), "a long, b long")


def _block_links(batches, percent: int):
    """Links of each group of rows sorted by (h, lb, mb)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        rows = pa.Table.from_batches(held).combine_chunks()
        starts = _group_starts(rows)
        yield _spanning(rows.slice(0, starts[-1]), percent)
        held = rows.slice(starts[-1]).to_batches()
    if held:
        yield _spanning(pa.Table.from_batches(held).combine_chunks(), percent)


def _group_starts(rows: pa.Table) -> np.ndarray:
    keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("h", "lb", "mb")])
    return np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))


def _spanning(rows: pa.Table, percent: int) -> pa.RecordBatch:
    found: list[tuple[int, int]] = []
    if rows.num_rows:
        asks, ids, n, comp = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "id", "n", "comp"))
        deltas = [np.frombuffer(x, U) for x in rows.column("delta").to_pylist()]
        starts = np.append(_group_starts(rows), rows.num_rows)
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            group = np.arange(lo, hi)
            left, right = group[asks[lo:hi]], group[~asks[lo:hi]]
            if len(left) and len(right):
                found += _group_links(left, right, ids, n, comp, deltas, percent)
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _group_links(left, right, ids, n, comp, deltas, percent: int) -> list[tuple[int, int]]:
    far = np.array([len(deltas[i]) for i in right])
    values, place = np.unique(np.concatenate([*(deltas[i] for i in right), np.zeros(0, U)]), return_inverse=True)
    edge = np.concatenate([[0], np.cumsum(far)])
    root = {}  # component -> component it is joined to in this group

    def top(c):
        while root.get(c, c) != c:
            c = root[c]
        return c

    out = []
    for i in left:
        mark = np.zeros(len(values), np.int64)
        if len(values):
            at = np.minimum(np.searchsorted(values, deltas[i]), len(values) - 1)
            mark[at[values[at] == deltas[i]]] = 1
        total = np.concatenate([[0], np.cumsum(mark[place])])
        differ = len(deltas[i]) + far - 2 * (total[edge[1:]] - total[edge[:-1]])
        close = (100 + percent) * differ <= (100 - percent) * (n[i] + n[right])
        for j in right[close & (comp[right] != comp[i])]:
            x, y = top(comp[i]), top(comp[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def _bands(batch: pa.RecordBatch, bands: int, rows: int):
    sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, HASHES)
    key = np.zeros((batch.num_rows, bands), U)
    for band in range(bands):
        value = np.full(batch.num_rows, band + 1, U)
        for j in range(rows):
            value = mix(value * U(31) + sig[:, band * rows + j].astype(U))
        key[:, band] = value
    each = pa.array(np.repeat(np.arange(batch.num_rows), bands))
    return {
        "key": key.reshape(-1),
        "band": np.tile(np.arange(bands), batch.num_rows),
        "id": batch.column("id").take(each),
        "n": batch.column("n").take(each),
    }


def _near(n, m, percent: int):
    """Sizes that allow the similarity: the smaller set is at least `percent` of the larger."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _pairs(met: DataFrame, percent: int) -> DataFrame:
    close = met.filter((F.col("id") != F.col("hub.id")) & _near(F.col("n"), F.col("hub.n"), percent))
    return close.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def least_matches(n: int, percent: int, miss: float) -> int:
    """Fewest matches of n after which P(similarity >= threshold | matches) is at least `miss`: with a
    uniform prior the posterior is Beta(m + 1, n - m + 1), whose tail is a binomial sum."""
    t, tail = percent / 100, 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def _likely(pairs: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Pairs that survive the batches of their signatures."""
    a = first.select(F.col("id").alias("ia"), F.col("sig").alias("sa"))
    b = first.select(F.col("id").alias("ib"), F.col("sig").alias("sb"))
    signed = pairs.join(a, F.col("a") == F.col("ia")).join(b, F.col("b") == F.col("ib")).select("a", "b", "sa", "sb")
    bounds = [(n, least_matches(n, percent, MISS)) for n in range(BATCH, HASHES + 1, BATCH)]

    def step(batch: pa.RecordBatch):
        left, right = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sa", "sb")
        )
        alive = np.arange(batch.num_rows)
        matches = np.zeros(batch.num_rows, np.int64)
        for n, least in bounds:
            part = slice(n - BATCH, n)
            matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
            alive = alive[matches[alive] >= least]
        kept = pa.array(alive)
        return {"a": batch.column("a").take(kept), "b": batch.column("b").take(kept)}

    return map_batches(signed, step, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    a = texts.select(F.col("id").alias("ia"), F.col("text").alias("ta"))
    b = texts.select(F.col("id").alias("ib"), F.col("text").alias("tb"))
    joined = pairs.join(a, F.col("a") == F.col("ia")).join(b, F.col("b") == F.col("ib")).select("a", "b", "ta", "tb")

    def step(batch: pa.RecordBatch):
        left, right = _sets(batch.column("ta"), shingle), _sets(batch.column("tb"), shingle)
        fine = []
        for x, y in zip(left, right, strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            fine.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
        return {c: batch.column(c).filter(pa.array(fine, pa.bool_())) for c in ("a", "b")}

    return map_batches(joined, step, "a long, b long")


def _sets(column: pa.Array, shingle: int):
    for lo, hi, data, offsets in pieces(column):
        doc, value = shingle_sets(data, offsets, shingle)
        yield from np.split(value, np.searchsorted(doc, np.arange(1, hi - lo)))

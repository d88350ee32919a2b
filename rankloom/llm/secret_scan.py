"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

Base spans come from three patterns (an assignment to a secret's name, an access key id, a long
hexadecimal run). The field tags tokens as begin, inside or outside of a secret from their shape,
the words and marks around them and features of the file, decoded by Viterbi; a span it finds is
added if it touches no base span.

The field is fitted on at most `sample` distinct texts with base spans and as many without (those with
the smallest hash, so the choice does not depend on partitioning or copies): base spans are its
labels, and half of the windows around them have the neighbouring words hidden, so that it learns the
shape of secrets and not only the patterns. Everything else reads every document whole.

Null or empty text: no spans. Repeated rows are scanned each. Extra columns are ignored. Without any
base span in the table the field finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import documents, map_batches, rewrite_texts
from rankloom.llm.crf import BEGIN, INSIDE, Crf
from rankloom.llm.text_arrays import LOWER, Words, pieces, span_hashes, split_words

SAMPLE = 1500
REACH = 10  # tokens on either side of a window's middle
STEP_BITS = 4  # bits of a hash, below its highest, that tell one step of its size from the next
STEPS = 64 << STEP_BITS

KINDS = ("assign", "access", "hex", "crf")
# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

# words that announce a secret, for the neighbour features
ANNOUNCING = (
    "password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "bearer", "credential",
    "credentials", "authorization", "auth", "passphrase", "private", "access",
)


def _class(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


DIGIT = _class(bytes(range(0x30, 0x3A)))
UPPER = _class(bytes(range(0x41, 0x5B)))
LOW = _class(bytes(range(0x61, 0x7B)))
HEX_LOW = _class(b"0123456789abcdef")
HEX_ANY = HEX_LOW | _class(b"ABCDEF")
INNER = _class(b"+/_.-")
WIDE = _class(bytes(range(0x80, 0x100)))
TOKEN = DIGIT | UPPER | LOW | INNER | WIDE
SETS, QUOTES = _class(b"=:"), _class(b"\"'")
LENGTHS = np.array([4, 8, 12, 16, 24, 40, 64])

GROUPS = [8, 5, 5, 2, 5, 4, 2, 4, 2, 4, 3, 40, 16]
NEIGHBOURS = [7, 8, 9, 12]  # groups that tell of the words around a token

SPANS = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"


def secret_spans(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end in code points, end exclusive; by start,
    then kind in the order of KINDS)."""
    source = documents(docs)
    held = docs.sparkSession.sparkContext.broadcast(_fitted(source, sample))

    def step(batch: pa.RecordBatch):
        for lo, hi, data, offsets in pieces(batch.column("text")):
            spans = _scan(data, offsets, held.value)
            yield {"doc_id": batch.column("doc_id").slice(lo, hi - lo), "spans": spans}

    return map_batches(source, step, SPANS)


def redacted_documents(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """All documents, all columns, with their secrets masked in the text."""
    held = docs.sparkSession.sparkContext.broadcast(_fitted(documents(docs), sample))

    def step(batch: pa.RecordBatch):
        for lo, hi, data, offsets in pieces(batch.column("text")):
            texts = batch.column("text").slice(lo, hi - lo).to_pylist()
            spans = _scan(data, offsets, held.value)
            masked = [redacted(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            yield hi - lo, pa.array(masked, pa.string()), np.ones(hi - lo, bool)

    return rewrite_texts(docs, step)


def _scan(data: np.ndarray, offsets: np.ndarray, model: Crf | None) -> list[list[dict]]:
    """Spans of a piece's documents, in code points."""
    found = base_spans(data, offsets)
    if model is not None:
        words, features = token_features(data, offsets)
        tags = model.decode(model.emissions(features), words.first)
        _add(found, words, tags, offsets)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out = []
    for d, own in enumerate(found):
        own.sort(key=lambda s: (s[1], KINDS.index(s[0])))
        base = points[offsets[d]]
        out.append([{"kind": k, "start": int(points[a] - base), "end": int(points[b] - base)} for k, a, b, _ in own])
    return out


def redacted(text: str, spans: list, mark: str = "<secret>") -> str:
    """`text` with `mark` in the place of each run of overlapping spans."""
    out, at = [], 0
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[str, int, int, int]]]:
    """For each document its base spans (kind, start, end, start of the secret itself), in bytes."""
    found: list[list] = [[] for _ in range(len(offsets) - 1)]
    runs = split_words(data, offsets, HEX_LOW)
    long = np.flatnonzero(runs.ends - runs.starts >= LEAST_HEX)
    owner = np.searchsorted(runs.first, long, "right") - 1
    for d, a, b in zip(owner.tolist(), runs.starts[long].tolist(), runs.ends[long].tolist(), strict=True):
        found[d].append(("hex", a, b, a))
    raw = data.tobytes()
    low = LOWER[data].tobytes()
    for d in _holding(low, NAMES, offsets):
        text = raw[offsets[d] : offsets[d + 1]].decode("latin-1")  # one character per byte; the patterns are ASCII
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_ASSIGN:
                found[d].append(("assign", *(int(offsets[d]) + x for x in (m.start(), m.end(), m.start(2)))))
    for d in _holding(raw, (b"AKIA",), offsets):
        text = raw[offsets[d] : offsets[d + 1]].decode("latin-1")
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST_ACCESS:
                a, b = int(offsets[d]) + m.start(), int(offsets[d]) + m.end()
                found[d].append(("access", a, b, a))
    return found


def _holding(raw: bytes, names: tuple[bytes, ...], offsets: np.ndarray) -> list[int]:
    """Documents in whose bytes one of the names occurs."""
    hit: set[int] = set()
    for name in names:
        at = raw.find(name)
        while at >= 0:
            d = int(np.searchsorted(offsets, at, "right")) - 1
            hit.add(d)
            at = raw.find(name, at + len(name))
    return sorted(hit)


_announcing = None


def token_features(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Tokens of a piece and their feature categories (tokens x GROUPS)."""
    global _announcing
    if _announcing is None:
        raw = np.frombuffer(" ".join(ANNOUNCING).encode(), np.uint8)
        names = split_words(raw, np.array([0, len(raw)]), TOKEN)
        _announcing = np.sort(span_hashes(raw, names.starts, names.ends))
    words = split_words(data, offsets, TOKEN)
    start, end = words.starts, words.ends
    n = len(start)
    size = end - start

    def count(flags: np.ndarray, a=start, b=end) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return total[b] - total[a]

    digits, upper, lower = count(DIGIT[data]), count(UPPER[data]), count(LOW[data])
    switch = np.zeros(len(data), bool)
    switch[1:] = DIGIT[data[1:]] != DIGIT[data[:-1]]
    switches = count(switch, np.minimum(start + 1, end), end)
    length = np.searchsorted(LENGTHS, size, "right")
    share = np.where(digits == 0, 0, np.where(digits == size, 4, 1 + (4 * digits >= size) + (4 * digits >= 3 * size)))
    first_upper = UPPER[data[start]] if n else np.zeros(0, bool)
    case = np.select(
        [(upper == 0) & (lower > 0), (lower == 0) & (upper > 0), (upper == 1) & first_upper, upper + lower == 0], [0, 1, 2, 3], 4
    )
    hexadecimal = ((count(HEX_ANY[data]) == size) & (size >= 16)).astype(np.int64)
    turns = np.searchsorted([1, 2, 4, 8], switches, "right")
    symbols = np.minimum(count(INNER[data]), 3)
    wide = (count(WIDE[data]) > 0).astype(np.int64)
    # what stands between a token and its neighbours in the same document
    doc = words.doc_of()
    before = np.concatenate([[0], end[:-1]])[:n] if n else start
    before = np.maximum(before, offsets[doc])
    after = np.append(start[1:], len(data))[:n] if n else start
    after = np.minimum(after, offsets[doc + 1])
    gap = 2 * (count(SETS[data], before, start) > 0) + (count(QUOTES[data], before, start) > 0)
    closed = (count(QUOTES[data], end, after) > 0).astype(np.int64)
    hashes = span_hashes(LOWER[data], start, end)
    at = np.minimum(np.searchsorted(_announcing, hashes), len(_announcing) - 1)
    named = _announcing[at] == hashes
    one, two = np.zeros(n, bool), np.zeros(n, bool)
    one[1:] = named[:-1] & (doc[1:] == doc[:-1])
    two[2:] = named[:-2] & (doc[2:] == doc[:-2])
    announced = 2 * one + two
    per_doc = count(SETS[data], offsets[:-1], offsets[1:])
    rate = np.searchsorted([1, 20], 1000 * per_doc // np.maximum(words.counts, 1), "right")[doc]
    columns = [length, share, case, hexadecimal, turns, symbols, wide, gap, closed, announced, rate, length * 5 + share, announced * 4 + gap]
    return words, np.stack(columns, axis=1).astype(np.int16) if n else np.zeros((0, len(GROUPS)), np.int16)


def _add(found: list[list], words: Words, tags: np.ndarray, offsets: np.ndarray) -> None:
    for i in np.flatnonzero(tags == BEGIN).tolist():
        d = int(np.searchsorted(words.first, i, "right")) - 1
        j = i
        while j + 1 < words.first[d + 1] and tags[j + 1] == INSIDE:
            j += 1
        a, b = int(words.starts[i]), int(words.ends[j])
        if not any(s < b and a < e for k, s, e, _ in found[d] if k != "crf"):
            found[d].append(("crf", a, b, a))


def _fitted(source: DataFrame, sample: int) -> Crf | None:
    """The field fitted on windows of the sampled documents, or None without a base span.

    One pass counts the distinct texts of either kind by the size of their hash; from the counts (at
    most 2 * STEPS rows, whatever the input) follows a bound on the hash that at least `sample` texts
    keep. A second pass looks only at texts below it and sends their windows, about `sample` of a kind."""
    bounds = _hash_bounds(source, sample)
    if bounds[True] is None:
        return None
    width = 2 * REACH + 1

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for _, _, data, offsets in pieces(batch.column("text")):
            rows = {"hash": [], "positive": [], "features": [], "tags": []}
            hashes = _text_numbers(data, offsets)
            below = {k: np.zeros(len(hashes), bool) if x is None else hashes <= x for k, x in bounds.items()}
            near = np.flatnonzero((below[True] | below[False]) & _has_token(data, offsets))
            data, offsets = _of_documents(data, offsets, near)
            found = base_spans(data, offsets)
            chosen = [d for d in range(len(near)) if below[bool(found[d])][near[d]]]
            data, offsets = _of_documents(data, offsets, np.array(chosen, np.int64))
            words, features = token_features(data, offsets)
            found = base_spans(data, offsets)
            for d, key in enumerate(hashes[near[chosen]].tolist()):
                a, b = int(words.first[d]), int(words.first[d + 1])
                tags = _gold(found[d], words, a, b)
                marked = np.flatnonzero(tags)
                if len(marked):
                    middle = int(marked[key % len(marked)])
                else:  # the token that looks most like a secret
                    own = features[a:b]
                    middle = int(np.argmax(own[:, 0].astype(np.int64) * 8 + own[:, 1] + own[:, 4] + (key % 5 == 0) * np.arange(b - a)))
                index = np.arange(middle - REACH, middle + REACH + 1)
                inside = (index >= 0) & (index < b - a)
                window = np.zeros((width, len(GROUPS)), np.int16)
                window[inside] = features[a + index[inside]]
                gold = np.zeros(width, np.int16)
                gold[inside] = tags[index[inside]]
                rows["hash"].append(key)
                rows["positive"].append(bool(found[d]))
                rows["features"].append(window.tobytes())
                rows["tags"].append(gold.tobytes())
            yield rows

    windows = map_batches(source.select("text"), step, "hash long, positive boolean, features binary, tags binary").distinct()
    listed = sorted(windows.collect(), key=lambda r: (r["hash"], r["features"], r["tags"]))
    both = [r for kind in (True, False) for r in [x for x in listed if x["positive"] == kind][:sample]]
    features = np.stack([np.frombuffer(r["features"], np.int16).reshape(width, len(GROUPS)) for r in both]).copy()
    tags = np.stack([np.frombuffer(r["tags"], np.int16) for r in both]).astype(np.int64)
    hidden = np.array([r["hash"] % 2 == 0 for r in both])
    for g in NEIGHBOURS:
        features[hidden, :, g] = 0
    return Crf.zero(GROUPS).fit(features, tags)


def _hash_bounds(source: DataFrame, sample: int) -> dict[bool, int | None]:
    """For texts with base spans and those without, a hash that at least `sample` distinct texts (or all)
    do not exceed; None without any. Steps grow with the hash, each a sixteenth of its power of two, so
    about `sample` texts, and at most some tenths more, lie below the bound at any size of the input."""

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for _, _, data, offsets in pieces(batch.column("text")):
            own = np.flatnonzero(_has_token(data, offsets))
            positive = np.array([bool(x) for x in base_spans(data, offsets)], bool)
            pairs = np.unique(np.stack([_text_numbers(data, offsets)[own], positive[own].astype(np.int64)], axis=1), axis=0)
            yield {"hash": pairs[:, 0], "positive": pairs[:, 1].astype(bool)}

    texts = map_batches(source.select("text"), step, "hash long, positive boolean").distinct()
    power = F.greatest(F.length(F.bin("hash")) - STEP_BITS - 1, F.lit(0))
    counts = (
        texts.withColumn("power", power.cast("int"))
        .withColumn("top", F.expr("shiftleft(shiftright(hash, power), power) + (shiftleft(1L, power) - 1)"))
        .groupBy("positive", "top")
        .agg(F.count("*").alias("n"))
    )
    rows = sorted((r["top"], r["positive"], r["n"]) for r in counts.collect())  # at most 2 * STEPS
    bounds: dict[bool, int | None] = {True: None, False: None}
    have = {True: 0, False: 0}
    for top, positive, n in rows:
        if have[positive] < sample:
            have[positive] += n
            bounds[positive] = top
    return bounds


def _has_token(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(TOKEN[data])])
    return total[offsets[1:]] > total[offsets[:-1]]


def _of_documents(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of some of a piece's documents."""
    parts = [data[offsets[d] : offsets[d + 1]] for d in chosen]
    joined = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return joined, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _text_numbers(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A number per document from its text, which decides on sampling."""
    return (span_hashes(data, offsets[:-1], offsets[1:]) >> np.uint64(1)).astype(np.int64)


def _gold(spans: list, words: Words, a: int, b: int) -> np.ndarray:
    tags = np.zeros(b - a, np.int64)
    for _, _, end, start in spans:
        i = int(np.searchsorted(words.ends[a:b], start, "right"))
        j = int(np.searchsorted(words.starts[a:b], end))
        tags[i:j] = INSIDE
        if i < j:
            tags[i] = BEGIN
    return tags

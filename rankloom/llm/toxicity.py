"""Toxicity scores of restored text: a noisy-channel decoder undoes obfuscation, then words are scored.

Channel. Disguised stretches (letters with digits or marks among or beside them, spaced runs of single
letters or marks, letters repeated three times or more), however long, become a character lattice: a mark
may stand for letters it resembles, or for nothing, a repeated letter for one or two of it, and a space for
nothing or the end of a word. One to three masking marks in a row may also stand for as many letters,
whichever ones: any that the documents hold after the two letters before. Letters are the lower-case
letters of the Latin, Greek and Cyrillic alphabets. Viterbi picks the path that the language model
together with the channel's costs finds likeliest. All other words are their own only reading and are
taken as they are.

Language model. Character n-grams of up to ORDER letters within words, counted over all documents; each
order backs off to the one below. Counts are kept by hash in SLOTS places an order, which bounds the
broadcast whatever the input; the one of single letters is exact.

Score. A word's weight is its smoothed log odds among toxic and clean labelled documents, learnt only
from rows outside the held-out part, from at most `sample` labelled documents of either label (those
with the smallest hash of their id; the curve's intercept is put back to the share of toxic rows among
all usable labels). A document's strongest words and their number, with its length,
go through a logistic curve fitted on the same rows.

Null or empty text: no words, scored by the curve's intercept. Repeated rows are scored each. Repeated
label rows: any toxic one makes the document toxic. Extra columns are ignored. Without labels of both
kinds every score is 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import cut_lineage, documents, map_batches
from rankloom.llm.text_arrays import LOWER, U, mix, mix_one, pieces, span_hashes, split_words

SAMPLE = 20_000
THRESHOLD = 0.3
HELD_OUT = 2  # remainder modulo 4 of crc32(doc_id as text) that is never learnt from
LEXICON = 5_000  # words kept, by weight
LEAST_Z = 5.0  # standard deviations by which a word must lean to toxic documents

# what a mark may stand for; the empty reading drops it
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "", ".": "", "-": "", "_": "", "#": "",
}
MASKS = "*#"  # marks that may hide any one letter
MASK_RUN = 3  # marks in a row; in a longer row they only separate
WILD = "?"
LAST = 0x1F00  # code points from here on are no letters of a stretch
LETTERS = "".join(c for c in map(chr, [*range(0x61, 0x530), *range(0x1E00, LAST)]) if c.isalpha() and c == c.lower())
SWAP_COST, DROP_COST, LOSS_COST, DOUBLE_COST = 1.0, 1.5, 6.0, 1.0  # LOSS: dropping a mark that can be a letter
MASK_COST = 1.0  # a letter behind a masking mark
SPLIT_COST = 1.0  # a space that ends a word in a spaced run

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
PLAIN = re.compile(f"[{LETTERS}]")
DROPPED = "".join(c for c, x in LOOKALIKES.items() if not x)  # marks that stand for no letter
_DROP = re.escape(DROPPED)
_SWAP = re.escape("".join(c for c, x in LOOKALIKES.items() if x))
_ANY = f"{LETTERS}{_SWAP}{_DROP}"
DISGUISED = re.compile(
    rf"(?<![{LETTERS}{_SWAP}])[{LETTERS}{_SWAP}](?:[ {_DROP}]{{1,3}}[{LETTERS}{_SWAP}]){{2,}}(?![{LETTERS}{_SWAP}])"  # one by one
    rf"|(?<![{_ANY}])(?=[{_SWAP}{_DROP}]*[{LETTERS}])"  # a stretch of letters and marks, with a letter and
    rf"(?=[{LETTERS}{_DROP}]*[{_SWAP}]"  # a mark that may be one,
    rf"|[{_DROP}]*[{LETTERS}]+[{_DROP}]+[{LETTERS}]"  # or a mark inside,
    rf"|[{_ANY}]*([{LETTERS}])\1\1)"  # or a letter three times
    rf"[{_ANY}]+"
)


ORDER = 4  # letters of the longest n-grams
SLOTS = 1 << 20  # places of an order's counts
BACKOFF = 4.0  # weight of the order below

# code points as lower-case letters, marks and spaces; 0 for all else
FOLD = np.zeros(LAST + 1, np.int32)
for _c in range(LAST):
    _low = chr(_c).lower()
    if len(_low) == 1 and (_low in LETTERS or _low in LOOKALIKES or _low == " "):
        FOLD[_c] = ord(_low)
IS_LETTER, IS_SWAP, IS_DROP = (np.zeros(LAST + 1, bool) for _ in range(3))
IS_LETTER[[ord(c) for c in LETTERS]] = True
IS_SWAP[[ord(c) for c, x in LOOKALIKES.items() if x]] = True
IS_DROP[[ord(c) for c in DROPPED]] = True


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= THRESHOLD)."""
    source = documents(docs)
    model = Grams(gram_counts(source))
    weights = _fitted(source, labels, model, sample)
    held = docs.sparkSession.sparkContext.broadcast((model, weights))

    def step(batch: pa.RecordBatch):
        model, weights = held.value
        for lo, hi, data, offsets in pieces(batch.column("text")):
            score = weights.scores(*readings(data, offsets, model))
            ids = batch.column("doc_id").slice(lo, hi - lo)
            yield {
                "doc_id": ids,
                "held_out": [held_out(i) for i in ids.to_pylist()],
                "score": score,
                "predicted": (score >= THRESHOLD).astype(np.int32),
            }

    return map_batches(source, step, "doc_id long, held_out boolean, score double, predicted int")


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == HELD_OUT


# --- language model -------------------------------------------------------------------------------


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A piece's code points through FOLD, and where its documents start."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return FOLD[np.minimum(points, LAST)], before[offsets]


def gram_slots(grams: list[np.ndarray]) -> np.ndarray:
    """The place of n-grams, given as arrays of their first, second, ... letters (0: the word's edge)."""
    value = np.asarray(grams[0], np.int64)
    for letter in grams[1:]:
        value = (value << 13) | letter  # LAST takes 13 bits
    if len(grams) == 1:
        return value
    return (mix(value.astype(U) + U(1)) >> U(44)).astype(np.int64)


def gram_slot(gram: tuple[int, ...]) -> int:
    """gram_slots of one n-gram, in plain integers, which is much faster for one."""
    value = 0
    for letter in gram:
        value = (value << 13) | letter
    return value if len(gram) == 1 else mix_one(value + 1) >> 44


def gram_counts(source: DataFrame) -> np.ndarray:
    """How often n-grams of 1 to ORDER letters occur in the words of all documents, edges included:
    ORDER x SLOTS. Place 0 of the first order counts words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ORDER, SLOTS), np.int64)
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column("text")):
                codes, starts = folded(data, offsets)
                c = np.insert(np.where(IS_LETTER[codes], codes, 0), starts, 0)  # a document's end is an edge
                total[0] += np.bincount(c[c > 0], minlength=SLOTS)
                total[0, 0] += np.count_nonzero((c[1:] == 0) & (c[:-1] > 0))
                for k in range(2, ORDER + 1):
                    grams = [c[i : len(c) - k + 1 + i] for i in range(k)]
                    inner = np.logical_and.reduce([g > 0 for g in grams[1:-1]]) if k > 2 else (grams[0] > 0) | (grams[1] > 0)
                    total[k - 1] += np.bincount(gram_slots([g[inner] for g in grams]), minlength=SLOTS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total.ravel()[seen], pa.int64())], ["gram", "n"])

    rows = source.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(ORDER * SLOTS, np.int64)
    found = rows.toArrow()  # at most ORDER * SLOTS rows
    counts[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return counts.reshape(ORDER, SLOTS)


class Grams:
    """The language model; costs are negative log probabilities. A context is a tuple of up to
    ORDER - 1 letters of the word so far, led by 0 while it reaches the word's start."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.letters = np.array([ord(c) for c in LETTERS])
        self.letters = self.letters[counts[0][self.letters] > 0]
        self.total = int(counts[0].sum()) + len(LETTERS) + 1
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, str] = {}
        self.costs: dict[tuple, float] = {}
        self.chances: dict[tuple, float] = {}
        self.followers: dict[tuple, list[int]] = {}

    def cost(self, context: tuple[int, ...], letter: int) -> float:
        """Of a letter, or of the word's end (0), after a context."""
        key = (*context, letter)
        found = self.costs.get(key)
        if found is None:
            if len(self.costs) > 100_000:
                self.costs.clear()
            found = self.costs[key] = -math.log(self._chance(key))
        return found

    def _chance(self, gram: tuple[int, ...]) -> float:
        """Of a gram's last letter after the others."""
        found = self.chances.get(gram)
        if found is None:
            if len(self.chances) > 100_000:
                self.chances.clear()
            if len(gram) == 1:
                found = (self._count(gram) + 1) / self.total
            else:
                every = self._count(gram[:-1])
                found = (min(self._count(gram), every) + BACKOFF * self._chance(gram[1:])) / (every + BACKOFF)
            if len(gram) < ORDER:  # the longest come back as costs
                self.chances[gram] = found
        return found

    def _count(self, gram: tuple[int, ...]) -> int:
        return self.counts.item(len(gram) - 1, gram_slot(gram))

    def after(self, context: tuple[int, ...]) -> list[int]:
        """Letters that the documents hold after the last two of a context."""
        key = context[-2:]
        if key not in self.followers:
            slots = gram_slots([*(np.full(len(self.letters), x) for x in key), self.letters])
            self.followers[key] = self.letters[self.counts[len(key), slots] > 0].tolist()
        return self.followers[key]

    def restore(self, text: str) -> str:
        """The likeliest reading of a disguised stretch."""
        if text not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[text] = self.decode(text)[0]
        return self.known[text]

    def decode(self, text: str) -> tuple[str, float]:
        """The likeliest reading and its cost, by Viterbi; words are joined by one space."""
        states: dict[tuple, tuple[float, tuple | None]] = {(0,): (0.0, None)}  # context -> cost and reading
        for ways in lattice(text):
            after: dict[tuple, tuple[float, tuple | None]] = {}
            for letters, price in ways:
                paths = {x: (cost + price, read) for x, (cost, read) in states.items()}
                for letter in letters:
                    paths = self._extended(paths, letter)
                for x, path in paths.items():
                    if x not in after or path[0] < after[x][0]:
                        after[x] = path
            states = after
        ends = ((cost + (self.cost(x, 0) if len(x) > 1 else 0.0), read) for x, (cost, read) in states.items())
        cost, read = min(ends, key=lambda end: end[0])
        out = []
        while read is not None:
            read, letter = read
            out.append(letter)
        return "".join(reversed(out)).strip(), cost

    def _extended(self, paths: dict, letter: str) -> dict:
        out: dict[tuple, tuple[float, tuple | None]] = {}
        for x, (cost, read) in paths.items():
            if letter == " ":
                moves = [((0,), cost + self.cost(x, 0), " ")] if len(x) > 1 else []  # no word to end
            else:
                some = self.after(x) if letter == WILD else [ord(letter)]
                moves = [((*x, c)[1 - ORDER :], cost + self.cost(x, c), chr(c)) for c in some]
            for y, total, c in moves:
                if y not in out or total < out[y][0]:
                    out[y] = (total, (read, c))
        return out


def lattice(text: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters its readings and their channel costs; WILD is any letter."""
    few = {i for m in re.finditer(f"[{_DROP}]+", text) if len(m[0]) <= MASK_RUN for i in range(*m.span())}
    out = []
    for run in re.finditer(r"(.)\1*", text, re.S):
        c, n = run[1], len(run[0])
        if c in LETTERS:
            ways = [(c, 0.0 if n == 1 else DOUBLE_COST)] + ([(c * 2, 0.0 if n == 2 else DOUBLE_COST)] if n > 1 else [])
        elif c == " ":
            ways = [("", 0.0), (" ", SPLIT_COST)]
        else:
            ways = [("", (LOSS_COST if LOOKALIKES.get(c) else DROP_COST))] + [(x * min(n, 2), SWAP_COST) for x in LOOKALIKES.get(c, "")]
            ways += [(x, SWAP_COST + DOUBLE_COST) for x in LOOKALIKES.get(c, "") if n > 1]
            if c in MASKS and run.start() in few:
                ways.append((WILD * n, MASK_COST * n))
        out.append(ways)
    return out


def readings(data: np.ndarray, offsets: np.ndarray, model: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word hash) of the words of a piece, as they stand and restored, and words per document."""
    low = LOWER[data]
    words = split_words(low, offsets, LETTER)
    hashes, doc = span_hashes(low, words.starts, words.ends), words.doc_of()
    extra_doc, extra = [], []
    for d in _suspects(data, offsets):
        text = data[offsets[d] : offsets[d + 1]].tobytes().decode().lower()
        for m in DISGUISED.finditer(text):
            if PLAIN.search(m[0]):
                found = model.restore(m[0]).split()
                extra += found
                extra_doc += [d] * len(found)
    if extra:
        joined = np.frombuffer(" ".join(extra).encode(), np.uint8)
        own = split_words(joined, np.array([0, len(joined)]), LETTER)
        hashes = np.concatenate([hashes, span_hashes(joined, own.starts, own.ends)])
        doc = np.concatenate([doc, np.array(extra_doc)])
    return doc, hashes, words.counts


def _suspects(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Documents that may hold a disguise: a mark that may be a letter in one stretch with letters, a mark
    inside a stretch, a letter three times, or three single letters or marks in a row."""
    low, starts = folded(data, offsets)
    if not len(low):
        return []
    plain, solid = IS_LETTER[low], IS_LETTER | IS_SWAP  # solid: letters and what may be one
    runs = split_words(low, starts, solid | IS_DROP)
    total = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    inside = lambda sums: sums[runs.ends] - sums[runs.starts]
    back = np.concatenate([[False], IS_DROP[low[:-1]] & solid[low[1:]]])  # a letter right after a dropped mark
    back[runs.starts] = False
    after = inside(total(back)) - IS_DROP[low[runs.starts]]
    hit = runs.starts[(inside(total(plain)) > 0) & ((inside(total(IS_SWAP[low])) > 0) | (after > 0))]
    three = np.flatnonzero(plain[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]))
    found = [hit, three]
    units = split_words(low, starts, solid)
    single = units.ends - units.starts == 1
    if len(single) > 2:
        near = units.starts[1:] - units.ends[:-1] <= 3
        found.append(units.starts[:-2][single[:-2] & single[1:-1] & single[2:] & near[:-1] & near[1:]])
    return np.unique(np.searchsorted(starts, np.concatenate(found), "right") - 1).tolist()


# --- scores ---------------------------------------------------------------------------------------


@dataclass
class Weights:
    words: np.ndarray  # sorted hashes
    weight: np.ndarray
    curve: np.ndarray  # intercept, strongest, second, number of weighty words per root of words

    def features(self, doc: np.ndarray, hashes: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        n = len(n_words)
        out = np.zeros((n, 4))
        out[:, 0] = 1
        if not len(self.words) or not len(hashes):
            return out
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        hit = np.flatnonzero(self.words[at] == hashes)
        pairs = np.unique(np.stack([doc[hit], at[hit]], axis=1), axis=0)  # a word counts once
        owner, weight = pairs[:, 0], self.weight[pairs[:, 1]]
        order = np.lexsort((-weight, owner))
        owner, weight = owner[order], weight[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        for k in (0, 1):
            out[owner[place == k], 1 + k] = weight[place == k]
        out[:, 3] = np.bincount(owner, weight > 2.0, n) / np.sqrt(1 + n_words)
        return out

    def scores(self, doc: np.ndarray, hashes: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(doc, hashes, n_words) @ self.curve, -50, 50)))


def _fitted(source: DataFrame, labels: DataFrame, model: Grams, sample: int) -> Weights:
    """Word weights and the curve, from a bounded sample of labelled rows that are not held out.

    The sample's ids (at most 2 * sample) are broadcast. Words are counted by Spark, and only those
    that lean to toxic documents, at most LEXICON, reach the driver. The curve is fitted on documents
    whose words had no part in the weights it sees: the sample has two folds, each scored with the
    other's words."""
    order = F.xxhash64("label_id")
    usable = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("label")
    )
    usable = usable.filter(F.crc32(F.col("label_id").cast("string")) % 4 != HELD_OUT)
    every = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = usable.filter("label = 1").orderBy(order, "label_id").limit(sample).unionByName(
        usable.filter("label = 0").orderBy(order, "label_id").limit(sample)
    )
    picked = picked.withColumn("fold", F.pmod(F.shiftright(order, 8), F.lit(2)).cast("int"))
    rows = cut_lineage(
        source.join(F.broadcast(picked), F.col("doc_id") == F.col("label_id")).select("text", "label", "fold")
    )
    size = {r["fold"]: (r["n"], r["t"]) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("t")).collect()}
    n, t = ([size.get(k, (0, 0))[i] for k in (0, 1)] for i in (0, 1))
    if not 0 < sum(t) < sum(n):
        return Weights(np.zeros(0, U), np.zeros(0), np.array([-50.0, 0, 0, 0]))
    held = source.sparkSession.sparkContext.broadcast(model)

    def count(batch: pa.RecordBatch):
        label, fold = (batch.column(c).to_numpy() for c in ("label", "fold"))
        words, kinds = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for lo, _, data, offsets in pieces(batch.column("text")):
            doc, hashes, _ = readings(data, offsets, held.value)
            pairs = np.unique(np.stack([doc.astype(U), hashes], axis=1), axis=0)
            owner = lo + pairs[:, 0].astype(np.int64)
            words.append(pairs[:, 1])
            kinds.append(2 * fold[owner] + label[owner])
        word, at = np.unique(np.concatenate(words), return_inverse=True)
        seen = [np.bincount(at, np.concatenate(kinds) == k, len(word)).astype(np.int64) for k in range(4)]
        return {"word": word, "n0": seen[0] + seen[1], "t0": seen[1], "n1": seen[2] + seen[3], "t1": seen[3]}

    counts = map_batches(rows, count, "word long, n0 long, t0 long, n1 long, t1 long").groupBy("word")
    counts = counts.agg(*[F.sum(c).alias(c) for c in ("n0", "t0", "n1", "t1")]).filter("t0 + t1 >= 3")
    counts = cut_lineage(counts)
    folds = [_lexicon(counts, "n1", "t1", n[1], t[1]), _lexicon(counts, "n0", "t0", n[0], t[0])]
    told = source.sparkSession.sparkContext.broadcast(folds)

    def measure(batch: pa.RecordBatch):
        fold = batch.column("fold").to_numpy()
        for lo, hi, data, offsets in pieces(batch.column("text")):
            both = [w.features(*readings(data, offsets, held.value)) for w in told.value]
            seen = np.where(fold[lo:hi, None] == 0, both[0], both[1])
            yield {"label": batch.column("label").slice(lo, hi - lo), "a": seen[:, 1], "b": seen[:, 2], "c": seen[:, 3]}

    measured = map_batches(rows, measure, "label int, a double, b double, c double")
    table = np.array(sorted(tuple(r) for r in measured.collect()))  # at most 2 * sample rows
    weights = _lexicon(counts, "n0 + n1", "t0 + t1", sum(n), sum(t))
    weights.curve = _logistic(np.hstack([np.ones((len(table), 1)), table[:, 1:]]), table[:, 0])
    # each label is sampled at its own rate, which moves the log odds by log(rate of toxic / rate of clean)
    toxic_rate, clean_rate = (min(1.0, sample / every[k]) for k in (1, 0))
    weights.curve[0] -= np.log(toxic_rate / clean_rate)
    return weights


def _lexicon(counts: DataFrame, every: str, toxic: str, n: int, n_toxic: int) -> Weights:
    """Words that lean to toxic documents, with their log odds."""
    if not 0 < n_toxic < n:
        return Weights(np.zeros(0, U), np.zeros(0), np.zeros(4))
    share = n_toxic / n
    z = (F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    seen = counts.select("word", F.expr(every).alias("n"), F.expr(toxic).alias("t")).filter("t >= 3")
    kept = seen.withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(LEXICON).collect()
    word = np.array([r["word"] for r in kept], np.int64).view(U)
    toxic_in, all_in = np.array([r["t"] for r in kept], float), np.array([r["n"] for r in kept], float)
    odds = np.log((toxic_in + 0.5) / (n_toxic + 1)) - np.log((all_in - toxic_in + 0.5) / (n - n_toxic + 1))
    place = np.argsort(word)
    return Weights(word[place], odds[place], np.zeros(4))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton steps for a ridge logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w

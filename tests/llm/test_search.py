"""Lexical search and importance resampling against plain restatements."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import lowered

from rankloom.llm import importance_sampling as S
from rankloom.llm import lexical_search as L

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_search(docs, items, k):
    held = [(d, Counter(TERMS.findall(lowered(t or "")))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(term for _, c in held for term in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, Counter()).update(TERMS.findall(lowered(text or "")))
    out = []
    for item, q in asked.items():
        found = []
        for d, c in held:
            if d is None:
                continue
            n, score = sum(c.values()), 0
            m = 75 + (25 * n * n_docs) // n_terms
            for term, many in q.items():
                if c[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += many * w * ((1000000000 * c[term]) // (1000 * c[term] + 12 * m))
            if score > 0:
                found.append((-score, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


def search_corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "Ça", "日本", "x1", *["w%d" % i for i in range(30)]]
    words = lambda k: rng.choice([" ", ", ", "--"]).join(rng.choice(vocabulary) for _ in range(k))
    docs = [(0, None), (1, ""), (2, "--- !"), (None, "the x1"), (3, words(4000))]
    docs += [(i, words(rng.randrange(1, 30))) for i in range(4, 120)]
    docs += [(1000 + i, "the x1 tie") for i in range(40)] + [(1000, "the x1 tie")]
    items = [(i, words(rng.randrange(1, 12))) for i in range(25)]
    items += [(3, "tie"), (3, "tie x1"), (90, None), (91, "?"), (None, "the"), (92, "absent"), (93, "tie " * 50)]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("seed, sizes", [(1, {}), (2, {"columns": 7, "doc_tile": 5, "item_tile": 3, "block_entries": 40})])
def test_search_is_exact_for_every_tiling(spark, seed, sizes):
    docs, items = search_corpus(seed)
    left = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, score int").repartition(4)
    right = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    got = sorted(map(tuple, L.lexical_search(left, right, k=6, **sizes).collect()))
    assert got == brute_search(docs, items, 6)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert L.lexical_search(docs.limit(0), items).count() == 0
    assert L.lexical_search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in L.lexical_search(docs, items).collect()] == [(1, 1, 1, brute_search([(1, "a")], [(1, "a")], 1)[0][3])]


def test_partial_sums_stay_below_2_to_the_53():
    stats = L.Statistics(10**12, 10**15, np.array([1, 5, 10**6]))
    q = np.array([10**8, 3, 10**5])
    vocabulary = np.array([10, 20, 30], np.uint64)
    tiles = L.build_tiles(np.array([7, 7, 7]), vocabulary, q, vocabulary, stats, 2, 4)
    sums = [sum(int(w) for w in part.worth) for part in tiles[0].parts]
    assert max(sums) * L.IMPACT < 2**53
    assert sum(sums) == sum(int(w) * int(x) for w, x in zip(L.weight(stats.n_docs, stats.df), q, strict=True))
    impact = np.array([999_999, 5, 77])
    scores = L.tile_scores(tiles[0], np.zeros(3, int), np.arange(3), impact, 1, 3)
    want = sum(int(a) * int(b) * int(c) for a, b, c in zip(L.weight(stats.n_docs, stats.df), q, impact, strict=True))
    assert scores.tolist() == [[want]]


def test_top_k_keeps_ties_for_the_smaller_id():
    rng = np.random.default_rng(4)
    top, seen = L.TopK(3, 5), []
    for _ in range(20):
        ids, scores = rng.permutation(1000)[:17], rng.integers(0, 4, (3, 17))
        top.add(ids, scores)
        seen.append((ids, scores))
    for item in range(3):
        rows = sorted((-int(s), int(d)) for ids, scores in seen for d, s in zip(ids, scores[item], strict=True) if s > 0)
        mine = top.item == item
        assert list(zip((-top.score[mine]).tolist(), top.doc[mine].tolist(), strict=True)) == rows[:5]


def test_impacts_are_integers_at_any_size():
    stats = L.Statistics(10**11, 10**13, np.zeros(0))
    n = np.array([10**9, 3])
    want = [(10**9 * 7) // (7000 + 12 * (75 + 25 * int(x) * 10**11 // 10**13)) for x in n]
    assert L.impacts(np.array([7, 7]), n, stats).tolist() == want


def brute_resample(docs, target, buckets, percent, min_words):
    def runs(text):
        w = WORDS.findall(lowered(text or ""))
        grams = [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
        return len(w), [zlib.crc32(g.encode()) % buckets for g in grams]

    every, aim = Counter(), Counter()
    for _, t in docs:
        every.update(runs(t)[1])
    for t in target:
        aim.update(runs(t)[1])
    total, wanted = sum(every.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (total + buckets) / ((every[b] + 1) * (wanted + buckets))))
    rows, can = [], []
    for d, t in docs:
        n, found = runs(t)
        weight = sum(map(gain, found))
        h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
        score = None if d is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((d, len(found), weight, score))
        if n >= min_words and d is not None:
            can.append((-score, d))
    ranks = {d: i + 1 for i, (_, d) in enumerate(sorted(can)[: percent * len(can) // 100])}
    return sorted(((*r, ranks.get(r[0])) for r in rows), key=str)


def test_resampling_is_exact(spark):
    rng = random.Random(9)
    vocabulary = ["The", "of", "Ça", "日本", "x1", "-", "\t", *["w%d" % i for i in range(50)]]
    words = lambda k: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(k))
    docs = [(0, None), (1, ""), (2, "?!"), (None, words(40)), (3, words(5000))]
    docs += [(i, words(rng.randrange(1, 60))) for i in range(4, 200)]
    target = [words(30) for _ in range(5)] + [None, "w1 w2 w3 w1 w2 w3"]
    left = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, rank int").repartition(5)
    right = spark.createDataFrame([(t,) for t in target], "text string")
    rows = S.importance_resample(left, right, percent=30, buckets=500).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, rows.collect()), key=str) == brute_resample(docs, target, 500, 30, 20)
    assert S.importance_resample(left.limit(0), right).count() == 0
    bare = S.importance_resample(left, right.limit(0), buckets=500).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, bare.collect()), key=str) == brute_resample(docs, [], 500, 5, 20)


@pytest.mark.parametrize("size", [1, 2, 7, 64, 10_000])
def test_features_do_not_depend_on_chunks(size):
    rng = random.Random(size)
    for _ in range(50):
        text = "".join(rng.choice(["ab", "C", " ", "\n", "é", "日", "9", "_"]) for _ in range(rng.randrange(0, 80)))
        got, n = Counter(), 0
        for many, runs in S.features(text.encode(), size):
            n += many
            for run in runs:
                got.update(run)
        w = WORDS.findall(lowered(text))
        want = Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) for k in (1, 2, 3) for i in range(len(w) - k + 1))
        assert (n, got) == (len(w), want)

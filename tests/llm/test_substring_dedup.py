"""Suffix-order and Lempel-Ziv de-duplication against brute force, in one and in many batches."""

import random

import numpy as np
import pytest
from brute import removed_substrings, removed_words

from rankloom.llm.anchors import DUPLICATE, MOST, covered, runs, sliding_argmin, unpacked
from rankloom.llm.factors import nearest_smaller
from rankloom.llm.rlz_dedup import longest_factors, parse, substring_dedup
from rankloom.llm.suffix_dedup import longest_previous_factor, suffix_dedup


@pytest.fixture(params=[10_000, 3])
def batches(request, spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, request.param)
    yield request.param
    spark.conf.unset(key)


def corpus(seed, n=90):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "ça", "日本", *["w%d" % i for i in range(60)]]
    words = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    common, passage = words(20), words(17)
    docs = [(0, None), (1, ""), (2, "short"), (3, "a" * 300), (4, "ab" * 400), (5, words(12))]
    for i in range(6, n):
        kind = rng.randrange(6)
        if kind == 0 and len(docs) > 8:
            text = rng.choice(docs)[1]
        elif kind == 1 and len(docs) > 8:
            parts = (rng.choice(docs)[1] or "").split(" ")
            parts[rng.randrange(len(parts))] = "edit"
            text = " ".join(parts)
        elif kind in (2, 3):
            text = words(rng.randrange(1, 15)) + " " + common + "\n" + words(rng.randrange(1, 15))
        elif kind == 4:
            text = passage + " " + words(40) + "\t" + passage
        else:
            text = words(rng.randrange(1, 60))
        docs.append((i * 7 - 3, text))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_is_exact(spark, batches, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, key string").repartition(5)
    for block_bytes in (1 << 21, 400):
        rows = suffix_dedup(df, width=40, gram=8, block_bytes=block_bytes).collect()
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
        assert len(rows) == len(docs)
        assert got == removed_substrings(docs, 40)


@pytest.mark.parametrize("seed", [3, 4])
def test_word_dedup_is_exact(spark, batches, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, spans string").repartition(5)
    for block_bytes in (1 << 21, 400):
        rows = substring_dedup(df, block_bytes=block_bytes).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == removed_words(docs, 13)


def test_defined_results_for_odd_tables(spark):
    schema = "doc_id long, text string"
    empty = spark.createDataFrame([], schema)
    assert suffix_dedup(empty).count() == 0 and substring_dedup(empty).count() == 0
    text = " ".join("w%d" % i for i in range(40))
    odd = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text), (2, text)], schema)
    assert {(r["doc_id"], r["n_removed"]) for r in substring_dedup(odd).collect()} == {(1, 0), (2, 40)}
    got = {r["doc_id"]: r for r in suffix_dedup(odd, texts=True).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == len(text) and bytes(got[2]["kept"]) == b""


def shared(values, i, j, most):
    n = 0
    while n < most and i + n < len(values) and j + n < len(values) and values[i + n] == values[j + n]:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(6))
def test_factors_are_the_longest_and_the_parse_is_greedy(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(3, 22, 40)
    words = rng.integers(0, 3 + seed, lengths.sum()).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    begin = np.cumsum(lengths) - lengths
    docs = np.sort(rng.integers(0, 12, 40))
    many = lengths - 2
    suffix = np.concatenate([np.arange(b, b + m) for b, m in zip(begin, many, strict=True)])
    owner, stretch = np.repeat(docs, many), np.repeat(np.arange(40), many)
    factor = longest_factors(words, begin, lengths, suffix, owner)
    ends = (begin + lengths)[stretch]
    for k, i in enumerate(suffix):
        want = max((shared(words, i, j, min(ends[k] - i, ends[m] - j)) for m, j in enumerate(suffix) if owner[m] < owner[k]), default=0)
        assert factor[k] == want
    starts, reach = parse(factor, np.cumsum(many) - many, many, 3)
    covered, got = set(), sorted(zip(starts.tolist(), reach.tolist(), strict=True))
    at = 0
    for k in range(len(suffix)):
        if k >= at or (k and stretch[k] != stretch[k - 1]):
            if factor[k] >= 3:
                assert got.pop(0) == (k, factor[k] - 2)
                covered |= set(range(k, k + int(factor[k]) - 2))
                at = k + factor[k] - 2
    assert not got and covered == set(np.flatnonzero(factor >= 3).tolist())


def test_nearest_smaller():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 9, 300):
        for top in (1, 3, 1000):
            v = rng.integers(0, top, n)
            before, after = nearest_smaller(v)
            assert before.tolist() == [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(n)]
            assert after.tolist() == [min((j for j in range(i + 1, n) if v[j] < v[i]), default=n) for i in range(n)]


def test_array_helpers():
    rng = np.random.default_rng(1)
    for width in (1, 2, 5, 9, 31):
        values = rng.integers(0, 6, 200)
        want = [i + int(np.argmin(values[i : i + width])) for i in range(200 - width + 1)]
        assert sliding_argmin(values, width).tolist() == want
    raw = rng.integers(97, 99, 300).astype(np.uint8)
    for width in (3, 8, 13, 100):
        at = np.arange(300 - width + 1)
        assert longest_previous_factor(raw, at, width).tolist() == [
            max((shared(raw, i, j, width) for j in range(i)), default=0) for i in at
        ]
    doc, at = runs(np.array([2, 1, 1, 2]), np.array([0, 5, 3, 2 * MOST]), np.array([2 * MOST, 1, 2, 4]))
    start, count, kind = unpacked(at)
    assert doc.tolist()[0] == 1 and (start[0], count[0]) == (3, 3) and set(kind) == {DUPLICATE}
    assert count.sum() == 3 + 2 * MOST + 4 and count.max() < MOST
    assert covered(6, at[:1], 1).tolist() == [False, False, False, True, True, True]
    assert not covered(4, at[:1], 1).any()

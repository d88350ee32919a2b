import random
from itertools import combinations

import pytest
from brute import near_duplicate_classes, shingle_set

from rankloom.llm.components import components
from rankloom.llm.minhash_dedup import BANDS, HASHES, ROWS, banding, least_matches, near_duplicates, signatures


def corpus(seed):
    rng = random.Random(seed)
    words = lambda k: [rng.choice("the of and ça X Y".split() + ["w%d" % i for i in range(300)]) for _ in range(k)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "two one"), (6, "ÉCOLE a"), (7, "école a")]
    n = 10
    for _ in range(8):
        base = words(rng.randrange(6, 150))
        docs.append((n, " ".join(base)))
        n += 1
        for _ in range(rng.randrange(0, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = "edit%d" % rng.randrange(50)
            docs.append((n, rng.choice([" ", "\t"]).join(copy).upper() if rng.random() < 0.3 else " ".join(copy)))
            n += 1
    # a chain: neighbours are alike, ends are not
    chain = words(200)
    for k in range(12):
        docs.append((n + 100 - k, " ".join(chain[5 * k : 5 * k + 140])))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, n int, key string").repartition(4)
    rows = near_duplicates(df).collect()
    want = near_duplicate_classes(docs)
    assert len(rows) == len(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    by_class = {}
    for r in rows:
        by_class.setdefault(r["class_id"], []).append(r["doc_id"])
    sets = {d: shingle_set(t) for d, t in docs}
    for same in by_class.values():
        assert all(sets[a] == sets[b] for a, b in combinations(same, 2))


def test_large_group_of_near_copies_makes_few_rows(spark):
    rng = random.Random(9)
    base = ["w%d" % rng.randrange(500) for _ in range(120)]
    docs = []
    for i in range(150):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(120)] = "e%d" % rng.randrange(1000)
        docs.append((i, " ".join(copy)))
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == near_duplicate_classes(docs)


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    odd = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "a b"), (3, "c")], schema)
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(odd).collect())
    assert got == [(1, 1, True), (2, 1, False), (3, 3, True)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {x: root(x) for a, b in edges for x in (a, b) if a != b}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_bounds():
    assert least_matches(32, 85, 0.5) >= 26 and least_matches(128, 85, 1e-6) < 109
    assert (1 - 0.85**ROWS) ** BANDS < 1e-5


def test_bands_follow_the_threshold():
    assert banding(85) == (BANDS, ROWS) == (20, 5) and banding(80) == (22, 4)
    for percent in range(9, 101):
        bands, rows = banding(percent)
        assert bands * rows <= HASHES and (1 - (percent / 100) ** rows) ** bands <= 1e-5
    assert banding(1) == (HASHES, 1)


def test_one_row_of_a_repeated_id_counts_everywhere(spark):
    """Ids with two different texts: links are those of the row that counts, never of the other."""
    base = [f"w{i}" for i in range(200)]
    near = base[:195] + [f"x{i}" for i in range(5)]
    far = base[:160] + [f"y{i}" for i in range(40)]
    rows, odd = [], []
    for g in range(40):
        tag = lambda words, g=g: " ".join(f"{w}g{g}" for w in words)
        rows.append((1000 * g, tag(base)))
        odd += [(1000 * g + 1, tag(near)), (1000 * g + 1, tag(far))]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").repartition(3)
    counted = {r["doc_id"]: (r["n"], r["mark"]) for r in signatures(docs, 5).collect()}
    marks = {(r["doc_id"], r["m"]): r["text"] for r in docs.selectExpr("doc_id", "xxhash64(text) AS m", "text").collect()}
    plain = [(d, marks[d, mark]) for d, (_, mark) in counted.items()]
    want = near_duplicate_classes(plain, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert got == want and 0 < sum(c != d for d, (_, c) in got.items()) < 40

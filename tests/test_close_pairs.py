"""Prefix-filtered joins and greedy heads against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import close_pairs as P
from rankloom.operators import clusters, coverage
from rankloom.operators.phrases import hashed_embedder


def pairs_of(groups):
    held = {}
    for r in groups.collect():
        held.setdefault((r["run_id"], r["f1"], r["f2"]), set()).add(r["item"])
    return {(run, a, b) for (run, _, _), items in held.items() for a in items for b in items if a < b}


def member_sets(seed, popular):
    rng = random.Random(seed)
    sets = {}
    for run in "rs":
        for i in range(50):
            elements = set(rng.sample([f"u{j}" for j in range(40)], rng.randrange(1, 9)))
            elements |= {f"p{j}" for j in range(popular) if rng.random() < 0.9}
            sets[run, f"k{i:02d}"] = elements
        sets[run, "copy"] = sets[run, "k07"]
    return sets


@pytest.mark.parametrize("hot", [1, 4, 64])
@pytest.mark.parametrize("m, popular", [(1, 0), (2, 1), (3, 0), (3, 4)])
def test_overlapping_sets_are_exact(spark, hot, m, popular):
    sets = member_sets(m + popular, popular)
    rows = [(run, item, e) for (run, item), s in sets.items() for e in s]
    members = spark.createDataFrame(rows, "run_id string, item string, element string").repartition(3)
    want = {
        (r, a, b) for (r, a), x in sets.items() for (q, b), y in sets.items() if r == q and a < b and len(x & y) >= m
    }
    assert pairs_of(P.overlapping_sets(members, m, hot)) == want


def test_a_popular_element_does_not_pair_its_holders(spark):
    rows = [("r", f"k{i}", f"p{j}") for i in range(400) for j in range(3)] + [("r", f"k{i}", f"u{i % 200}") for i in range(400)]
    members = spark.createDataFrame(rows, "run_id string, item string, element string")
    groups = P.overlapping_sets(members, 3)
    assert groups.count() <= 4 * 400  # all pairs would be 79,800
    heads = clusters.greedy_set_heads(members.select("run_id", "item").distinct().withColumn("order", F.struct("item")), members, 3)
    assert heads.select("head").distinct().count() == 1


def sparse_vectors(rng, n):
    out = []
    for _ in range(n):
        v = np.zeros(30)
        for d in rng.choice(30, rng.integers(1, 6), replace=False):
            v[d] = rng.integers(1, 4) * rng.choice([1, 1, 1, -1])
        out.append(v / np.linalg.norm(v))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.8, 0.9])
def test_close_vectors_are_exact(spark, threshold):
    rng = np.random.default_rng(5)
    left, right = sparse_vectors(rng, 70), sparse_vectors(rng, 60)
    left[3], right[7] = np.zeros(30), left[0]
    frame = lambda rows: spark.createDataFrame(
        [("rs"[i % 2], str(i), i, v.tolist()) for i, v in enumerate(rows)],
        "run_id string, item string, order long, vector array<double>",
    ).select("run_id", "item", "order", P.sparse(F.col("vector")).alias("entries"))
    got = {(r["item"], r["other"]): r["similarity"] for r in P.close_vectors(frame(left), frame(right), threshold).collect()}
    want = {
        (str(i), str(j)): round(float(x @ y), 12)
        for i, x in enumerate(left) for j, y in enumerate(right) if i % 2 == j % 2 and round(float(x @ y), 12) >= threshold
    }
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-11 for k in got)


def greedy_vectors(vectors, threshold):
    heads, out = [], []
    for i, v in enumerate(vectors):
        head = next((h for h in heads if round(float(vectors[h] @ v), 12) >= threshold), None)
        if head is None:
            heads.append(i)
            head = i
        out.append(head)
    return out


def test_heads_of_vectors_with_copies(spark):
    rng = np.random.default_rng(8)
    vectors = sparse_vectors(rng, 60)
    vectors += [vectors[i] for i in rng.integers(0, 60, 60)]
    want = greedy_vectors(vectors, 0.7)
    rows = [("r", f"i{i}", i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "run_id string, item string, order int, vector array<double>").repartition(4)
    got = {r["item"]: r["head"] for r in clusters.greedy_vector_heads(df, 0.7).collect()}
    assert got == {f"i{i}": f"i{h}" for i, h in enumerate(want)}
    assert clusters.greedy_vector_heads(df.limit(0), 0.7).count() == 0


def test_heads_of_dense_vectors_in_blocks(spark):
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(90, 24))
    vectors[60:] = vectors[:30]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    want = greedy_vectors(vectors, 0.35)
    rows = [("r", f"i{i}", i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "run_id string, item string, order int, vector array<double>")
    for block in (2048, 13):
        got = {r["item"]: r["head"] for r in clusters.greedy_vector_heads(df, 0.35, block).collect()}
        assert got == {f"i{i}": f"i{h}" for i, h in enumerate(want)}


def test_close_pairs_of_dense_vectors_are_never_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 24)) * 0.2 + rng.normal(size=24)  # all close: 79,800 pairs
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [("r", f"i{i}", i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "run_id string, item string, order int, vector array<double>")
    steps = []

    def counted(step):
        out = kept(step)
        steps.append(out.count())
        return out

    kept = P.cut_lineage
    monkeypatch.setattr(P, "cut_lineage", counted)
    monkeypatch.setattr(clusters, "cut_lineage", counted)
    heads = clusters.greedy_vector_heads(df, 0.3, 64).collect()
    assert {r["head"] for r in heads} == {"i0"} and len(heads) == 400
    assert max(steps) == 400  # pairs would be 159,600 rows in one of them


def test_heads_of_dense_vectors_of_many_runs_in_rounds(spark):
    rng = np.random.default_rng(12)
    runs = {"r": 300, "s": 40, "t": 1}
    rows, want = [], {}
    for run, n in runs.items():
        vectors = rng.normal(size=(n, 24))
        vectors[n // 2 :: 7, -3:] = 0  # shorter without their last zeros
        vectors[n // 3 :: 9, 4] = 0
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        if run == "r":
            vectors[[20, 250]] = 0  # close to nothing, not even to each other
            vectors[100:110] = vectors[3]
        names = [f"{run}{i}" for i in rng.permutation(n)]  # the order is not that of the names
        rows += [(run, name, (i // 10, i % 10), v.tolist()) for i, (name, v) in enumerate(zip(names, vectors))]
        want |= {name: names[h] for name, h in zip(names, greedy_vectors(vectors, 0.5))}
    rows.append(("t", "none", (9, 9), None))
    want["none"] = "none"
    schema = "run_id string, item string, order struct<a: int, b: int>, vector array<double>"
    df = spark.createDataFrame(rows, schema).repartition(5)
    for block in (2048, 32):
        got = [(r["item"], r["head"]) for r in clusters.greedy_vector_heads(df, 0.5, block).collect()]
        assert sorted(got) == sorted(want.items())
    few = df.filter("run_id = 's'")
    got = {r["item"]: r["head"] for r in clusters.greedy_vector_heads(few, 0.5, 3).collect()}
    assert got == {k: v for k, v in want.items() if k.startswith("s")}


def test_vectors_without_entries_are_close_to_nothing(spark):
    rows = [("r", "a", 0, [0.0, 0.0]), ("r", "b", 1, [0.0, 0.0]), ("r", "c", 2, [1.0, 0.0]), ("r", "d", 3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "run_id string, item string, order int, vector array<double>")
    got = {r["item"]: r["head"] for r in clusters.greedy_vector_heads(df, 0.3).collect()}
    assert got == {"a": "a", "b": "b", "c": "c", "d": "c"}


def test_heads_of_a_long_chain(spark):
    n = 60  # every item is close to the one before it only
    rows = [("r", i, g) for i in range(n) for g in (i, i + 1)]
    groups = spark.createDataFrame(rows, "run_id string, n int, f1 int").select(
        "run_id", F.format_string("i%02d", "n").alias("item"), F.col("f1").cast("long").alias("f1"), F.lit(0).cast("long").alias("f2")
    )
    items = groups.select("run_id", "item").distinct().withColumn("order", F.col("item"))
    got = {r["item"]: r["head"] for r in P.ordered_heads(items, groups).collect()}
    assert got == {f"i{i:02d}": f"i{i - i % 2:02d}" for i in range(n)}


def test_best_match_above_a_threshold(spark):
    texts = ["red garden chair", "red garden chairs cheap", "blue sofa", "sofa blue", "lamp", "the of"]
    left = spark.createDataFrame([("r", x) for x in texts], "run_id string, item string")
    right = spark.createDataFrame(
        [("r", "garden chair red", 4), ("r", "chair garden red", 2), ("r", "sofas, blue", 9), ("s", "lamp", 1)],
        "run_id string, item string, order long",
    )
    embed = lambda df: hashed_embedder(df, "item", "vector")
    got = {r["item"]: (r["match"], r["similarity"]) for r in clusters.best_match_above(embed(left), embed(right), 0.85).collect()}
    assert got["red garden chair"] == ("chair garden red", 1.0)
    assert got["red garden chairs cheap"][0] == "chair garden red" and abs(got["red garden chairs cheap"][1] - 3 / 12**0.5) < 1e-9
    assert got["blue sofa"] == got["sofa blue"] == ("sofas, blue", 1.0)
    assert set(got) == {"red garden chair", "red garden chairs cheap", "blue sofa", "sofa blue"}


def test_a_word_in_every_passage_is_cut_up(spark):
    rng = random.Random(3)
    passages = [("r", i % 50, i, "alpha " + " ".join(f"w{rng.randrange(40)}" for _ in range(6))) for i in range(3000)]
    labels = [("r", "alpha"), ("r", "Alphas w3"), ("r", "w1 w2"), ("r", "w5"), ("r", "zeta alpha"), ("s", "alpha")]
    p = spark.createDataFrame(passages, "run_id string, page int, passage_no int, passage string")
    w = spark.createDataFrame(labels, "run_id string, label string")
    got = sorted((r["passage_no"], r["label"]) for r in coverage.passage_hits(p, w).collect())
    stems = {"Alphas w3": {"alpha", "w3"}}
    want = sorted(
        (i, label) for _, _, i, text in passages for run, label in labels
        if run == "r" and stems.get(label, set(label.split())) <= set(text.split())
    )
    assert got == want
    rows = p.select("run_id", "page", "passage_no", F.explode(F.split("passage", " ")).alias("word"))
    counts = rows.groupBy("run_id", "word").agg(F.count("*").alias("n"))
    heavy = coverage.heavy_keys(counts, ["run_id", "word"], 200)
    few = counts.select("run_id", "word")
    place = ["run_id", "page", "passage_no"]
    assert coverage.split_join(rows, few, ["run_id", "word"], heavy, place).count() == rows.count()
    salts = rows.join(heavy, ["run_id", "word"]).withColumn("salt", F.pmod(F.xxhash64(*place), "salts"))
    sizes = sorted(r["count"] for r in salts.groupBy("word", "salt").count().collect())
    assert heavy.count() <= 200 and sizes[-1] <= 4 * sizes[len(sizes) // 2] < 3000


def test_hits_are_found_across_blocks_of_passages_and_labels(spark):
    rng = random.Random(4)
    passages = [("rs"[i % 2], i % 20, i, " ".join(f"w{rng.randrange(30)}" for _ in range(12))) for i in range(300)]
    labels = [("r", "w1"), ("r", "w2 w3"), ("r", "w3 w2"), ("r", "w4 w5 w6"), ("s", "w7 w7"), ("s", "the of"), ("t", "w1"), ("r", "zeta w1")]
    p = spark.createDataFrame(passages, "run_id string, page int, passage_no int, passage string")
    w = spark.createDataFrame(labels + labels[:2], "run_id string, label string")
    hits = coverage.passage_hits(p, w, passage_block=40, label_block=2)
    got = sorted((r["run_id"], r["page"], r["passage_no"], r["label"]) for r in hits.collect())
    want = sorted(
        (run, page, i, label) for run, page, i, text in passages for of, label in labels
        if of == run and label != "the of" and set(label.split()) <= set(text.split())
    )
    assert got == want and len({r[3] for r in got}) == 5
    assert hits.schema["passage_no"].dataType.typeName() == "integer"
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan  # candidates stay in their task


def test_totals_of_labels_are_those_of_their_hits_and_hits_are_never_rows(spark):
    rng = random.Random(5)
    passages = [("rs"[i % 2], i // 9, i // 9 < 2, i, " ".join(f"w{rng.randrange(9)}" for _ in range(5))) for i in range(300)]
    passages += [("r", 80, False, 301, "the"), ("r", 81, False, 302, None), ("u", 90, True, 303, "w1")]
    labels = [("r", f"w{a} w{b} w{c}") for a in range(9) for b in range(a + 1) for c in range(b + 1)]
    labels += [("s", "w1"), ("s", "the"), ("s", "w2 w3 w4 w5"), ("r", "zeta w1"), ("t", "w1"), ("r", "w8 w1 w2")]
    lists = [("r", labels[i % 40][1], i // 4) for i in range(60)] + [("s", "w1", 1), ("s", "w1", 3), ("r", "w1 w1 w1", 80), ("r", "w1 w1 w1", 99)]
    p = spark.createDataFrame(passages, "run_id string, page int, ours boolean, passage_no int, passage string")
    w = spark.createDataFrame(labels + labels[:2], "run_id string, label string")
    listed = spark.createDataFrame(lists, "run_id string, topic string, page int").distinct()
    pages = p.select("run_id", "page", "ours").distinct()
    counts = coverage.page_counts(coverage.passage_hits(p, w), pages).localCheckpoint()
    want = sorted(tuple(r) for r in coverage.page_totals(counts, listed).collect())
    held = coverage.held_words(p)
    for blocks in ((40, 30), (1000, 1000)):
        found = coverage.label_totals(held, w, listed, *blocks)
        assert sorted(tuple(r) for r in found.select("run_id", "label", "pages", "both", "ours_passages").collect()) == want
        per_page = coverage.label_pages(held, w, *blocks).select("run_id", "label", "page", "n", "ours")
        assert sorted(map(tuple, per_page.collect())) == sorted(map(tuple, counts.select(*per_page.columns).collect()))
    assert len(want) > 100 and any(r[3] for r in want) and any(r[4] > 1 for r in want)
    assert "passage_no" not in found.columns and found.count() < coverage.passage_hits(p, w).count() / 5

"""The pipeline on a small table, against plain restatements of its stages."""

import random
from collections import defaultdict

import public_tokenizers
import pytest
from brute import WORDS, near_duplicate_classes

import corpus_pipeline
from rankloom.llm.token_ids import tokenizer


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    words = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    items = [(i, words(25)) for i in range(5)]
    docs = []
    for i in range(60):
        text = words(rng.randrange(60, 120)) + "."
        if i % 10 == 3:
            text += "\n" + items[i % 5][1] + " end of it."
        if i % 10 == 5:
            text = docs[i - 2][1]
        if i % 10 == 6:
            text = docs[i - 6][1] + " one more word."
        if i % 10 == 7:
            text += '\ntoken = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '" is here now.'
        if i % 10 == 8:
            text += "\nmenu\nhome\n| | a | |"
        if i % 10 == 9:
            text = rng.choice(["too short", "", None, "again and again " * 60])
        docs.append((i, text, "en", "src", len(text or "")))
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def test_stages(spark, folder):
    path, docs, items = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "packing"]
    cleaned = []
    for doc_id, text, *_ in docs:
        n = len(WORDS.findall(text or ""))
        if n >= 50 and not text.startswith("again"):
            kept = [x for x in text.split("\n") if x not in ("menu", "home", "| | a | |")]
            cleaned.append((doc_id, "\n".join(kept)))
    classes = near_duplicate_classes(cleaned)
    unique = [(d, t) for d, t in cleaned if classes[d][1] == d]
    bad = {" ".join(WORDS.findall(t)[i : i + 10]) for _, t in items for i in range(16)}
    safe = [(d, t) for d, t in unique if not any(g in t for g in bad)]
    rows = corpus_pipeline.run(spark, path).collect()
    library = tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    by_doc = defaultdict(int)
    for r in rows:
        by_doc[r["doc_id"]] += r["length"]
    assert set(by_doc) == {d for d, _ in safe}
    assert 20 < len(safe) < len(unique) < len(cleaned) < len(docs)
    for d, t in safe:
        if "token =" not in t:
            assert by_doc[d] == len(library.encode(t, add_special_tokens=False).ids) + 1
        else:
            assert by_doc[d] < len(library.encode(t, add_special_tokens=False).ids) - 5


def test_stages_keep_the_columns(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.limit(0), path).count() == 0


def test_near_duplicate_stage_takes_four_fifths(spark):
    rng = random.Random(4)
    docs, pairs = [], 0
    for n in (112, 120, 150):
        for k in range(2, 14):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            copy = base[:40] + [f"x{rng.randrange(10**6)}" for _ in range(k)] + base[40 + k :]
            docs += [(len(docs), " ".join(base)), (len(docs) + 1, " ".join(copy))]
            pairs += 0.80 <= (n - 8 - k) / (n + k) < 0.85
    assert pairs > 8 and (112 - 8 - 8) / (112 + 8) == 0.8
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicate(spark, table, "").collect()}
    want = near_duplicate_classes(docs, percent=80)
    assert got == {d for d, _ in docs if want[d][1] == d}
    assert got != {d for d, (_, c) in near_duplicate_classes(docs).items() if c == d}


def test_decontamination_judges_each_row_by_its_own_text(spark, folder):
    path, _, items = folder
    hit, clean = "before " + items[0][1] + " after", "nothing of the kind here"
    rows = [(None, hit), (None, clean), (7, hit), (7, clean), (8, clean), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.decontamination(spark, docs, path).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([r for r in rows if r[1] != hit], key=str)

import random

from pyspark.sql import functions as F

from rankloom.llm.chat_format import escaped, format_paths, read_back, reply_paths, turn_chains, unescaped

NASTY = ["<s>", "<\\s>", "<\\\\/s>", "[INST]", "[\\INST]", "<|end|>\n", "<|turn|>", "<<SYS>>", "<<\\<SYS>>", "\\", "\n", "é", "", "<", "["]


def test_escaping_is_reversible_and_hides_control_strings(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(NASTY) for _ in range(rng.randrange(0, 7))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", escaped(F.col("t")).alias("e"), unescaped(escaped(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in ("<s>", "</s>", "[INST]", "<|end|>", "<|turn|>", "<<SYS>>"))


def brute_paths(rows):
    known = {(t, i) for t, i, *_ in rows}
    kids = {}
    for t, i, p, *_ in rows:
        kids.setdefault((t, p if (t, p) in known else None), []).append(i)
    by_id = {(t, i): (r, x, s or 0.0) for t, i, p, r, x, s in rows}
    out = {}

    def walk(t, i, path):
        path = [*path, i]
        below = kids.get((t, i), [])
        if not below:
            out[(t, i)] = (sum(by_id[t, n][2] for n in path), [by_id[t, n][:2] for n in path])
        for k in below:
            walk(t, k, path)

    for (t, p), roots in list(kids.items()):
        if p is None:
            for i in roots:
                walk(t, i, [])
    return out


def test_paths_of_random_trees(spark):
    rng = random.Random(4)
    rows = []
    for t in range(12):
        for i in range(rng.randrange(1, 25)):
            parent = None if i == 0 else rng.choice([i - 1, i - 1, rng.randrange(i), 99])
            rows.append((t, i, parent, rng.choice(["user", "assistant", None]), rng.choice([*NASTY, None]), rng.choice([0.0, 1.0, 2.5, None])))
    rows += [(50, 1, 2, "user", "circle", 0.0), (50, 2, 1, "user", "circle", 0.0), (None, 1, None, "user", "x", 0.0)]
    messages = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")
    want = brute_paths([r for r in rows if r[0] is not None and r[0] != 50])
    got = {}
    for r in reply_paths(messages).collect():
        got.setdefault((r["tree"], r["leaf"]), []).append(r)
    assert set(got) == set(want)
    for key, mine in got.items():
        mine.sort(key=lambda r: r["place"])
        assert [(r["role"], r["text"]) for r in mine] == want[key][1]
        better = sum(k[0] == key[0] and (-v[0], k[1]) < (-want[key][0], key[1]) for k, v in want.items())
        assert mine[0]["branch"] == better + 1
    assert {r["branch"] for r in reply_paths(messages, top=1).collect()} == {1}


def test_turns_and_mask_read_back(spark):
    rows = [(1, 0, "user", "<s>hi"), (1, 1, "assistant", "[INST] é"), (1, 2, "as\nsi stant", None), (1, 2, "user", "tie"),
            (2, 0, None, ""), (None, 0, "user", "lost"), (3, 5, "assistant", "x" * 5000), (3, 5, "assistant", "x" * 5000)]
    table = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, place int")
    paths = format_paths(reply_paths(turn_chains(table)))
    got = sorted((r["tree"], r["place"], r["role"], r["text"], r["masked"]) for r in read_back(paths).collect())
    want = [(1, 0, "user", "<s>hi", False), (1, 1, "assistant", "[INST] é", True), (1, 2, "as\nsi stant", "", False), (1, 3, "user", "tie", False),
            (2, 0, "", "", False), (3, 0, "assistant", "x" * 5000, True), (3, 1, "assistant", "x" * 5000, True)]
    assert got == want
    for r in paths.collect():
        assert all(0 <= s["start"] <= s["end"] <= len(r["formatted"]) for s in r["loss_mask"])
    assert reply_paths(turn_chains(table.limit(0))).count() == 0

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers

from rankloom.llm.packing import best_fit, pack
from rankloom.llm import token_ids
from rankloom.llm.token_ids import CellCache, little_endian, tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_best_fit_packs_every_piece_within_capacity_and_close_to_the_bound():
    rng = random.Random(3)
    for trial in range(60):
        capacity = rng.choice([10, 50, 2048])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 400))]
        histogram = defaultdict(int)
        for x in lengths:
            histogram[x] += 1
        used, bins = defaultdict(int), 0
        for pattern, times in best_fit(dict(histogram), capacity):
            assert times > 0 and sum(pattern) <= capacity
            bins += times
            for x in pattern:
                used[x] += times
        assert used == histogram
        large = sum(x > capacity // 2 for x in lengths)
        bound = max(-(-sum(lengths) // capacity), large)
        assert bins <= bound * 1.12 + 1, (trial, bins, bound)


def test_dominance_finds_the_best_packing_of_small_instances():
    assert best_fit({6: 1, 4: 1, 5: 2}, 10) == [((6, 4), 1), ((5, 5), 1)]
    assert best_fit({10: 3}, 10) == [((10,), 3)]
    assert best_fit({7: 2, 3: 2, 2: 1}, 10) == [((7, 3), 2), ((2,), 1)]
    assert best_fit({}, 10) == []


def test_rows_are_gapless_and_the_ids_are_the_librarys(spark):
    rng = random.Random(5)
    words = ["Alpha", "be-ta", "gämma", "<|endoftext|>", "DELTA's", "x" * 40, "12345", "\t", "　"]
    texts = [None, "", "same", "same"] + [
        " ".join(rng.choice(words) for _ in range(rng.randrange(0, 90))) + rng.choice(["", "\n\n ", " ,"])
        for _ in range(60)
    ]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    rows = pack(docs, PATH, capacity=64).collect()
    library, by_doc, by_sequence = tokenizer(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        mine = sorted(by_doc[i], key=lambda r: r["piece"])
        assert len(mine) == -(-len(ids) // 64)
        for k, r in enumerate(mine):
            part = ids[64 * k : 64 * k + 64]
            assert (r["piece"], r["start"], r["length"]) == (k, 64 * k, len(part))
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for mine in by_sequence.values():
        at = 0
        for r in sorted(mine, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert pack(docs.limit(0), PATH).count() == 0


def test_plain_cells_are_encoded_by_words_in_few_calls_with_the_ids_of_the_library(monkeypatch):
    signs = "".join(map(chr, range(0x21, 0x7F)))
    letters = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
    rng = random.Random(5)
    cells = {"".join(rng.choices(signs + letters, k=rng.randrange(1, 9))) for _ in range(3000)}
    cells |= {"Word,", "word", "WORD.", "it's", "H\u0331a", "\u00d7", "<|endoftext|>", "", "a\tb", "İx", "数12", "ΑΣ", *signs, *letters}
    cache = CellCache(PATH, little_endian)
    asked = []
    whole = cache._ask_whole
    monkeypatch.setattr(cache, "_ask_whole", lambda some: (asked.extend(some), whole(some)), raising=False)
    cache.ask(cells)
    library = tokenizer(PATH)
    for cell in cells:
        assert cache[cell] == little_endian(library.encode(cell, add_special_tokens=False).ids), cell
    assert not {"Word,", "word", "WORD."} & set(asked) and {"it's", "<|endoftext|>", "ΑΣ"} <= set(asked)
    assert token_ids.word_ends(tokenizer(public_tokenizers.path("byte_bpe_50k.json"))) is None

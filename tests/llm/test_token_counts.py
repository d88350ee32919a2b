import random

import public_tokenizers
import pytest

from rankloom.llm.token_counts import chunked_count, token_counts, word_cells
from rankloom.llm.token_ids import tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["the ", "Word", " ", "  ", "\n", "\t", "é", "日本", "<|endoftext|>", "<|endof", "12", "'s", "!!", " ", "\x1c", "😀", "aaaa"]


def brute(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def library():
    return tokenizer(PATH)


def random_text(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def test_cells_give_the_librarys_counts(library):
    rng = random.Random(1)
    for _ in range(400):
        text = random_text(rng, rng.randrange(0, 30))
        assert "".join(word_cells(text)) == text
        assert sum(brute(library, c) for c in word_cells(text)) == brute(library, text), repr(text)


@pytest.mark.parametrize("chunk, overlap", [(200, 70), (300, 150), (1000, 200)])
def test_chunks_splice_to_the_librarys_counts(library, chunk, overlap):
    rng = random.Random(chunk)
    for _ in range(40):
        text = random_text(rng, 600)
        assert chunked_count(library, text, chunk, overlap) == brute(library, text), repr(text)


def test_overlap_widens_when_there_is_no_boundary(library):
    for text in ("x" * 3000, "x" * 1000 + " y" * 400, "é" * 900 + "\n" * 900 + "z" * 500, " " * 2000 + "a"):
        assert chunked_count(library, text, 300, 80) == brute(library, text)


def test_query_rows(spark, library):
    texts = [None, "", "one two", "<|endoftext|> two", "word " * 2000, "nospace" * 9000, "one two"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r for r in token_counts(docs, PATH, chunk=4096).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        n = brute(library, text)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(text.encode()), n, n > 1024)
    assert token_counts(docs.limit(0), PATH).count() == 0

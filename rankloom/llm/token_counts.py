"""Token counts of whole texts, exactly as the tokenizer's library counts them.

A huge document is encoded in overlapping chunks, with offsets. Two neighbouring chunks are spliced
at a boundary that both place at the same character and that is proven stable: in both encodings a
pre-token starts there, it ends far enough from either chunk's cut that no later character can move
it, and it lies outside special strings. From such a boundary on, the pre-tokenizer, which scans
from left to right, sees the same text in both encodings. If the overlap holds no such boundary
it is widened, up to the rest of the text.

Other documents are cut into cells at single spaces between two non-space characters, where the
pre-tokenizer always cuts, and each distinct cell is encoded once per worker (see token_ids).

Null or empty text: no tokens. Repeated rows are counted each on its own; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm.common import documents, map_batches
from rankloom.llm.text_arrays import pieces
from rankloom.llm.token_ids import CellCache

CHUNK = 32_768  # characters; longer texts are encoded in overlapping chunks
OVERLAP = 512
MARGIN = 64  # characters from a cut within which no boundary is trusted; longer than special strings
LIMIT = 1024

_CUT = re.compile(r"(?<=\S) (?=\S)")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(
    docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""

    def step(batch: pa.RecordBatch):
        cache = CellCache.of(path, len)
        for lo, hi, data, offsets in pieces(batch.column("text")):
            texts = batch.column("text").slice(lo, hi - lo).to_pylist()
            n_tokens = [0] * len(texts)
            cells = []
            for i, text in enumerate(texts):
                if len(text) > chunk:
                    n_tokens[i] = chunked_count(cache.library, text, chunk, overlap)
                    cells.append([])
                else:
                    cells.append(word_cells(text))
            cache.ask({c for own in cells for c in own})
            for i, own in enumerate(cells):
                n_tokens[i] += sum(map(cache.__getitem__, own))
            counted = np.array(n_tokens, np.int64)
            yield {
                "doc_id": batch.column("doc_id").slice(lo, hi - lo),
                "n_bytes": np.diff(offsets),
                "n_tokens": counted,
                "over_limit": counted > limit,
            }

    return map_batches(documents(docs), step, SCHEMA)


def word_cells(text: str) -> list[str]:
    """Cells of a text, cut before each single space between two characters that aren't spaces."""
    words = text.split(" ")
    if "" in words or not _plain(text):
        return [text[a:b] for a, b in _spans(text)]
    return [words[0], *[" " + w for w in words[1:]]] if text else []


def _plain(text: str) -> bool:
    """No white space but spaces between words and line breaks within them."""
    return len(text.split(" ")) == len(_CUT.findall(text)) + 1


def _spans(text: str) -> list[tuple[int, int]]:
    cuts = [0, *[m.start() for m in _CUT.finditer(text)], len(text)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def chunked_count(library, text: str, chunk: int, overlap: int) -> int:
    """Tokens of a long text from overlapping chunks spliced at stable common boundaries."""
    total, at = 0, 0  # `at`: proven boundary from which the text is still to be counted
    end = min(len(text), chunk)
    left = _Encoded(library, text, 0, end)
    while left.end < len(text):
        wide = overlap
        while True:
            start = max(at, left.end - wide)
            stop = min(len(text), left.end + chunk)
            right = _Encoded(library, text, start, stop)
            common = _common_boundary(left, right, at)
            if common is not None:
                break
            if start == at and stop == len(text):
                common = at  # no boundary anywhere: the rest in one piece
                break
            wide *= 2
            if start == at:  # nothing more on the left: take in more on the right
                chunk *= 2
        total += left.tokens_between(at, common)
        left, at = right, common
    return total + left.tokens_between(at, len(text))


class _Encoded:
    """A chunk's encoding: token starts as characters of the whole text, and pre-token starts."""

    def __init__(self, library, text: str, start: int, end: int) -> None:
        self.start, self.end = start, end
        got = library.encode(text[start:end], add_special_tokens=False)
        self.at = np.array([o[0] for o in got.offsets], np.int64) + start
        word = np.array([-1 if w is None else w for w in got.word_ids], np.int64)
        fresh = np.ones(len(word), bool)
        fresh[1:] = (word[1:] != word[:-1]) & (self.at[1:] > self.at[:-1])
        self.words = self.at[fresh & (word >= 0)]

    def tokens_between(self, lo: int, hi: int) -> int:
        return int(np.count_nonzero((self.at >= lo) & (self.at < hi)))


def _common_boundary(left: _Encoded, right: _Encoded, least: int) -> int | None:
    lo = right.start + MARGIN if right.start > least else right.start
    hi = left.end - MARGIN
    common = np.intersect1d(left.words, right.words)
    common = common[(common >= lo) & (common < hi) & (common > least)]
    return int(common[len(common) // 2]) if len(common) else None

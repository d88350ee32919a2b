"""Quality rules, line first: punctuation, navigation and boilerplate rules are evaluated on each
line, failing lines are removed, and a document that loses too much of its text is rejected.

Null or empty text: no words, rejected by the minimum word count. Repeated rows are assessed each
on its own. Extra columns are ignored. Any length: work is done in pieces of whole documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm.common import documents, map_batches, rewrite_texts
from rankloom.llm.text_arrays import LOWER, NOT_SPACE, Words, gram_hashes, mix, pieces, span_hashes, split_words

SYMBOLS = b"#*$%&|<>"
TERMINAL = b".!?:;,\"')]}"
BARS = b"|/>"

# Phrases that mark a line as boilerplate. A parameter: pass others for other sites.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "accept cookies", "enable javascript", "subscribe to our newsletter", "click here to",
    "powered by", "skip to content", "lorem ipsum",
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    repeat_percent: int = 50  # base check: share of words in repeated 3-word windows
    short_line_words: int = 4  # a line of fewer words must end in punctuation
    bar_percent: int = 30  # navigation: share of words that are a lone bar, slash or angle
    symbol_percent: int = 100  # punctuation: symbols of a line against its words
    lost_percent: int = 60  # a document that loses more of its words than this is rejected
    boilerplate: tuple[str, ...] = field(default=BOILERPLATE)


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " n_lines long, n_bad_punctuation long, n_navigation long, n_boilerplate long, lost_words long,"
    " base_failed boolean, kept boolean"
)


def quality_rules(docs: DataFrame, rules: Rules = Rules(), cleaned: bool = False) -> DataFrame:
    """One row per document with its counts and verdict; with `cleaned`, also `clean_text`, the
    text without its failing lines."""
    schema = SCHEMA + (", clean_text string" if cleaned else "")

    def step(batch: pa.RecordBatch):
        ids, texts = batch.column("doc_id"), batch.column("text")
        for lo, hi, data, offsets in pieces(texts):
            columns, lines = assess(data, offsets, rules)
            columns["doc_id"] = ids.slice(lo, hi - lo)
            if cleaned:
                columns["clean_text"] = clean(data, offsets, *lines)
            yield columns

    return map_batches(documents(docs), step, schema)


def cleaned_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, all columns, their texts without failing lines."""

    def step(batch: pa.RecordBatch):
        for lo, hi, data, offsets in pieces(batch.column("text")):
            columns, lines = assess(data, offsets, rules)
            yield hi - lo, clean(data, offsets, *lines), columns["kept"]

    return rewrite_texts(docs, step)


def assess(data: np.ndarray, offsets: np.ndarray, rules: Rules):
    """Counts and verdicts of a piece's documents, and its lines (starts, ends, documents, which to drop)."""
    words = split_words(data, offsets, NOT_SPACE)
    n_words, doc_of_word = words.counts, words.doc_of()
    inside = NOT_SPACE[data] & ((data & 0xC0) != 0x80)
    symbols = _table(SYMBOLS)[data]
    line_start, line_end, line_doc = _lines(data, offsets)
    first_word = np.searchsorted(words.starts, line_start)
    line_words = np.searchsorted(words.starts, line_end) - first_word
    spoken = line_words > 0
    start, end, doc, count = line_start[spoken], line_end[spoken], line_doc[spoken], line_words[spoken]
    n_docs = len(n_words)

    keys = mix(span_hashes(data, start, end) + mix(doc.astype(np.uint64)))
    distinct = np.unique(keys, return_index=True)[1]
    n_dup_lines = np.bincount(doc, minlength=n_docs) - np.bincount(doc[distinct], minlength=n_docs)
    repeated = _repeated_words(words, doc_of_word)

    last_byte = data[words.ends[(first_word + line_words)[spoken] - 1] - 1] if len(start) else data[:0]
    unpunctuated = (count < rules.short_line_words) & ~_table(TERMINAL)[last_byte]
    unpunctuated |= 100 * _between(symbols, start, end) >= rules.symbol_percent * count
    bar = (words.ends - words.starts == 1) & _table(BARS)[data[words.starts]]
    bars = _between(bar, first_word[spoken], first_word[spoken] + count)
    navigation = 100 * bars >= rules.bar_percent * count
    boilerplate = np.zeros(len(start), bool)
    low = LOWER[data].tobytes()
    for phrase in rules.boilerplate:
        raw, at = phrase.encode(), low.find(phrase.encode())
        while at >= 0:
            line = int(np.searchsorted(start, at, "right")) - 1
            if line >= 0 and at + len(raw) <= end[line]:
                boilerplate[line] = True
            at = low.find(raw, at + 1)
    bad = unpunctuated | navigation | boilerplate
    lost = np.bincount(doc[bad], count[bad], n_docs).astype(np.int64)
    n_repeat = np.bincount(doc_of_word[repeated], minlength=n_docs)
    base_failed = (n_words < rules.min_words) | (100 * n_repeat > rules.repeat_percent * n_words)
    drop = np.zeros(len(line_start), bool)
    drop[np.flatnonzero(spoken)[bad]] = True
    columns = {
        "n_words": n_words,
        "word_chars": _between(inside, offsets[:-1], offsets[1:]),
        "n_symbols": _between(symbols, offsets[:-1], offsets[1:]),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
        "n_lines": np.bincount(doc, minlength=n_docs),
        "n_bad_punctuation": np.bincount(doc[unpunctuated], minlength=n_docs),
        "n_navigation": np.bincount(doc[navigation], minlength=n_docs),
        "n_boilerplate": np.bincount(doc[boilerplate], minlength=n_docs),
        "lost_words": lost,
        "base_failed": base_failed,
        "kept": ~base_failed & (100 * lost <= rules.lost_percent * n_words),
    }
    return columns, (line_start, line_end, line_doc, drop)


def clean(data: np.ndarray, offsets: np.ndarray, start, end, owner, drop) -> pa.Array:
    """Texts without the dropped lines; untouched texts stay byte for byte."""
    raw = data.tobytes()
    touched = set(owner[drop].tolist())
    out = []
    for d in range(len(offsets) - 1):
        if d in touched:
            mine = np.flatnonzero((owner == d) & ~drop)
            out.append(b"\n".join(raw[start[i] : end[i]] for i in mine).decode())
        else:
            out.append(raw[offsets[d] : offsets[d + 1]].decode())
    return pa.array(out, pa.string())


def _lines(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends and documents of the \\n-separated lines; an empty text has none."""
    breaks = np.flatnonzero(data == 0x0A)
    filled = np.flatnonzero(np.diff(offsets))
    start = np.concatenate([offsets[filled], breaks + 1])
    doc = np.concatenate([filled, np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    # a line ends one byte before the next line of its text starts, or with the text
    end = np.append(start[1:], len(data) + 1) - 1
    last = np.append(doc[1:] != doc[:-1], True)
    end[last] = offsets[doc[last] + 1]
    return start, end, doc


def _repeated_words(words: Words, doc_of_word: np.ndarray) -> np.ndarray:
    """Which words lie in a 3-word window that the document holds twice or more."""
    covered = np.zeros(len(words.starts), bool)
    grams = gram_hashes(span_hashes(words.data, words.starts, words.ends), 3)
    whole = doc_of_word[:-2] == doc_of_word[2:] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    keys = mix(grams[at] + mix(doc_of_word[at].astype(np.uint64)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for j in range(3):
        covered[at[twice] + j] = True
    return covered


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


def _between(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[end] - total[start]

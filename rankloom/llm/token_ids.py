"""Token ids of whole texts by a tokenizer file, with a bounded cache of word-sized cells.

Tokenizers split a text into words before they merge, so a text cut where a word always ends gives
the same ids cell by cell. Most cells recur, and a cell's ids are computed once per worker.

Where the tokenizer is known to lower-case and to split into runs of letters, single digits and runs
of signs, new cells of plain characters are cut into those words: fewer are distinct ("Word", "word," and
"word" hold the same one), and many words are encoded in one call. A mark at each word's last token
tells the calls' words apart again; where their number is not the expected one, they are encoded singly.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterable

import numpy as np

CACHE_CELLS = 1_000_000  # about 200 MB in a worker; emptied when full
CALL = 4096  # cells or words of one call

WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# ASCII without spaces, apostrophes (contractions) and < (special strings), and the composed letters of Latin-1
_PLAIN = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+")
_WORD = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")  # WORDS in a plain, lower-case cell

_loaded: dict[str, CellCache] = {}


def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def word_ends(library) -> np.ndarray | None:
    """Which ids end a word, for tokenizers whose words are those of WORDS, lower-cased; else None."""
    suffix = getattr(library.model, "end_of_word_suffix", None)
    if not suffix or library.normalizer is None or library.pre_tokenizer is None:
        return None
    rules = json.loads(library.normalizer.__getstate__()).get("normalizers", [])
    splits = json.loads(library.pre_tokenizer.__getstate__()).get("pretokenizers", [])
    if [r["type"] for r in rules] != ["NFC", "Replace", "Lowercase"] or rules[1]["pattern"] != {"Regex": r"\s+"}:
        return None
    if [s["type"] for s in splits] != ["Split", "ByteLevel"] or splits[1]["use_regex"] or splits[1]["add_prefix_space"]:
        return None
    if splits[0] != {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}:
        return None
    vocab = library.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[at for token, at in vocab.items() if token.endswith(suffix)]] = True
    return ends


class CellCache(dict):
    """cell -> value of its ids; `ask` computes the cells of many texts in one call. `value` must make
    the sum of the values of a cell's words the value of the cell."""

    def __init__(self, path: str, value) -> None:
        super().__init__()
        self.library, self.value = tokenizer(path), value
        self.ends = word_ends(self.library)

    @classmethod
    def of(cls, path: str, value) -> CellCache:
        key = f"{path}:{value.__name__}"
        if key not in _loaded:
            _loaded[key] = cls(path, value)
        return _loaded[key]

    def ask(self, cells: Iterable[str]) -> None:
        if len(self) > CACHE_CELLS:
            self.clear()
        new = [c for c in cells if c not in self]
        if self.ends is not None:
            new = self._ask_plain(new)
        self._ask_whole(new)

    def _ask_whole(self, cells: list[str]) -> None:
        for lo in range(0, len(cells), CALL):
            part = cells[lo : lo + CALL]
            for cell, got in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self[cell] = self.value(got.ids)

    def _ask_plain(self, cells: list[str]) -> list[str]:
        """Computes the plain cells from their words and returns the others."""
        plain = {c: _WORD.findall(c.lower()) for c in cells if _PLAIN.fullmatch(c)}
        words = list({w for own in plain.values() for w in own if w not in self})
        for lo in range(0, len(words), CALL):
            part = words[lo : lo + CALL]
            ids = self.library.encode(" ".join(part), add_special_tokens=False).ids
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) != len(part) or stops[-1] != len(ids):
                self._ask_whole(part)
                continue
            at = 0
            for word, stop in zip(part, stops, strict=True):
                self[word] = self.value(ids[at:stop])
                at = stop
        for cell, (first, *rest) in plain.items():
            value = self[first]
            for word in rest:
                value += self[word]
            self[cell] = value
        return [c for c in cells if c not in plain]


def little_endian(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)

"""Texts of an Arrow batch as byte, word and n-gram arrays.

Everything works on bounded pieces of a batch (whole documents, about PIECE_BYTES of text), so
memory does not grow with the batch. Hashes are polynomial over bytes or words, modulo 2**64,
then mixed; `lane` picks one of two independent bases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACES
ALNUM_OR_WIDE = np.zeros(256, bool)
ALNUM_OR_WIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True
# the contract's word class keeps 0-9, a-z after lower-casing, and everything beyond ASCII
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def mix_one(h: int) -> int:
    """`mix` of one value."""
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return h ^ (h >> 31)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n, modulo 2**64."""
    have = _powers.get(lane)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE_BYTES + 1024)
        base = _BASES[lane]
        have = tuple(
            np.cumprod(np.concatenate([[U(1)], np.full(size - 1, b, U)]), dtype=U)
            for b in (base, pow(base, -1, 1 << 64))
        )
        if size <= 4 * PIECE_BYTES:  # tables of one huge document are not kept
            _powers[lane] = have
    return have


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    raw = column.buffers()
    if not len(column) or raw[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole documents of about `limit` bytes."""
    data, offsets = text_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


@dataclass
class Words:
    """Words of a piece in order; those of document d are first[d] to first[d+1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes of the class `inside`; runs end at document ends."""
    mask = inside[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    opens, closes = mask.copy(), mask.copy()
    opens[1:] &= ~mask[:-1]
    closes[:-1] &= ~mask[1:]
    opens[edge] = mask[edge]
    closes[edge - 1] = mask[edge - 1]
    starts = np.flatnonzero(opens)
    return Words(data, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of the bytes of each span."""
    power, inverse = powers(lane, len(data) + 1)
    prefix = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def gram_hashes(words: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hashes of k consecutive values at each start, across documents: the caller drops those
    that straddle two documents."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    base = U(_BASES[lane])
    out = words[:n].copy()
    for j in range(1, k):
        out *= base
        out += words[j : j + n]
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out

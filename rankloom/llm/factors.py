"""Longest earlier factors of a block of symbols, by suffix order and nearest smaller owners.

Suffixes are put in order by prefix doubling. For a suffix, the longest match that starts in an earlier
owner (a smaller position, or a document with a smaller id) is shared with the nearest suffix before or
after it in that order whose owner is smaller: suffixes further away share no more. The common length of
two suffixes comes from the ranks of the doubling rounds, largest first.

Blocks are of bounded size; everything is array arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from rankloom.llm.text_arrays import U


def prefix_ranks(first: np.ndarray, length: int, depth: int) -> list[tuple[int, np.ndarray]]:
    """(length, rank of the substring of that length at each place), doubling from `length` until
    `depth` is reached. `first`: a number for the substring of `length` symbols at each place. Beyond
    the end of the block comes a symbol smaller than all others."""
    rank = np.unique(first, return_inverse=True)[1].astype(U) + U(1)
    levels = [(length, rank)]
    while length < depth:
        ahead = np.concatenate([rank[length:], np.zeros(min(length, len(rank)), U)])
        rank = np.unique((rank << U(32)) | ahead, return_inverse=True)[1].astype(U) + U(1)
        length *= 2
        levels.append((length, rank))
    return levels


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest smaller value before and after each value; -1 and len(values) for none."""

    def before(v: np.ndarray) -> np.ndarray:
        at = np.arange(len(v)) - 1
        left = np.flatnonzero(at >= 0)
        left = left[v[at[left]] >= v[left]]
        while len(left):
            # whatever lies between a place and where it points is not smaller than it: jump
            at[left] = at[at[left]]
            left = left[at[left] >= 0]
            left = left[v[at[left]] >= v[left]]
        return at

    return before(values), len(values) - 1 - before(values[::-1])[::-1]


def common_length(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols the suffixes at a and b share, in whole substrings of the first level; below twice the
    largest level."""
    shared = np.zeros(len(a), np.int64)
    for length, rank in reversed(levels):
        at, to = a + shared, b + shared
        inside = (at < len(rank)) & (to < len(rank))
        same = np.zeros(len(a), bool)
        same[inside] = rank[at[inside]] == rank[to[inside]]
        shared += np.where(same, length, 0)
    return shared


def longest_earlier(
    levels: list[tuple[int, np.ndarray]], suffix: np.ndarray, owner: np.ndarray, room: np.ndarray, finish=None
) -> np.ndarray:
    """For each place of `suffix` the length of its longest match with a suffix of a smaller owner, at
    most `room` (the symbols up to the end of its stretch, on either side). `finish(a, b, shared)` adds
    what is shared below the first level."""
    out = np.zeros(len(suffix), np.int64)
    if not len(suffix):
        return out
    order = np.lexsort((np.arange(len(suffix)), levels[-1][1][suffix]))
    place, held, left = suffix[order], owner[order], room[order]
    best = np.zeros(len(order), np.int64)
    for other in nearest_smaller(held):
        some = np.flatnonzero((other >= 0) & (other < len(order)))
        to = other[some]
        shared = common_length(levels, place[some], place[to])
        if finish is not None:
            shared = finish(place[some], place[to], shared)
        shared = np.minimum(shared, np.minimum(left[some], left[to]))
        best[some] = np.maximum(best[some], shared)
    out[order] = best
    return out


def in_blocks(block_bytes: int, work: Callable[[pa.Table, int | None], pa.RecordBatch]):
    """For mapInArrow over rows sorted by `key`: work(rows, split) on blocks of about `block_bytes` that
    end where a key ends, unless a key is larger than that: `split` is the last key that was cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        split = None
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) < block_bytes:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = rows.column("key").to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield work(rows.slice(0, last), split)
                held = rows.slice(last).to_batches()
            else:
                split = keys[-1]
                yield work(rows, split)
                held = []
        if held and sum(b.num_rows for b in held):
            yield work(pa.Table.from_batches(held).combine_chunks(), split)

    return run

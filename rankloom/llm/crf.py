"""A linear-chain conditional random field over token features, in numpy arrays.

A token's features are categories, one for each group; a group's table holds a weight for each
category and tag. Tags: 0 outside, 1 begin, 2 inside.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
TAGS = 3


@dataclass
class Crf:
    tables: list[np.ndarray]  # one per group: categories x tags
    moves: np.ndarray  # from tag x to tag; a chain starts and ends outside

    @classmethod
    def zero(cls, sizes: list[int]) -> Crf:
        return cls([np.zeros((n, TAGS)) for n in sizes], np.zeros((TAGS, TAGS)))

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """Scores (..., TAGS) of tokens with features (..., groups)."""
        out = self.tables[0][features[..., 0]]
        for g in range(1, len(self.tables)):
            out = out + self.tables[g][features[..., g]]
        return out

    def fit(self, features: np.ndarray, tags: np.ndarray, rounds: int = 80, rate: float = 0.2, shrink: float = 1e-3) -> Crf:
        """Maximum conditional likelihood of tags (chains x length) by Adam; `shrink` is the weight
        of the squared norm. Inside cannot follow outside."""
        n = max(1, len(tags))
        params = [*self.tables, self.moves]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        one_hot = np.eye(TAGS)[tags]
        for t in range(1, rounds + 1):
            node, edge = self._marginals(self.emissions(features))
            gap = one_hot - node
            grads = [
                np.stack([np.bincount(features[..., g].ravel(), gap[..., k].ravel(), len(table)) for k in range(TAGS)], 1)
                for g, table in enumerate(self.tables)
            ]
            padded = np.pad(tags, ((0, 0), (1, 1)))
            seen = np.bincount((padded[:, :-1] * TAGS + padded[:, 1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
            grads.append(seen - edge)
            for i, (p, g) in enumerate(zip(params, grads, strict=True)):
                g = g / n - shrink * p
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                p += rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-8)
            self.moves[OUTSIDE, INSIDE] = -20.0
        return self

    def _marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tag probabilities of each token and expected counts of moves, by forward and backward sums."""
        chains, length, _ = scores.shape
        ahead, back = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = self.moves[OUTSIDE] + scores[:, 0]
        for i in range(1, length):
            ahead[:, i] = _log_sum(ahead[:, i - 1, :, None] + self.moves, 1) + scores[:, i]
        back[:, -1] = self.moves[:, OUTSIDE]
        for i in range(length - 2, -1, -1):
            back[:, i] = _log_sum(self.moves + (scores[:, i + 1] + back[:, i + 1])[:, None, :], 2)
        total = _log_sum(ahead[:, -1] + self.moves[:, OUTSIDE], 1)
        node = np.exp(ahead + back - total[:, None, None])
        edge = np.zeros((TAGS, TAGS))
        edge[OUTSIDE] += node[:, 0].sum(0)
        edge[:, OUTSIDE] += node[:, -1].sum(0)
        for i in range(1, length):
            pair = ahead[:, i - 1, :, None] + self.moves + (scores[:, i] + back[:, i])[:, None, :]
            edge += np.exp(pair - total[:, None, None]).sum(0)
        return node, edge

    def decode(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best tags of the chains first[d] to first[d + 1] by Viterbi.

        Where a token's score for outside leads by more than any neighbours could make up for, it is
        outside on every best path; the stretches between such tokens are decoded one by one."""
        tags = np.zeros(len(scores), np.int8)
        most = max(
            (self.moves[p, t] + self.moves[t, q]) - (self.moves[p, OUTSIDE] + self.moves[OUTSIDE, q])
            for t in (BEGIN, INSIDE)
            for p in range(TAGS)
            for q in range(TAGS)
        )
        open_ = np.flatnonzero(scores[:, OUTSIDE] - scores[:, 1:].max(axis=1) < most)
        if not len(open_):
            return tags
        chain = np.searchsorted(first, open_, "right")
        cut = np.flatnonzero((np.diff(open_) > 1) | (np.diff(chain) > 0)) + 1
        for part in np.split(open_, cut):
            tags[part] = self._viterbi(scores[part])
        return tags

    def _viterbi(self, scores: np.ndarray) -> np.ndarray:
        best = self.moves[OUTSIDE] + scores[0]
        back = np.zeros((len(scores), TAGS), np.int8)
        for i in range(1, len(scores)):
            ways = best[:, None] + self.moves
            back[i] = ways.argmax(axis=0)
            best = ways.max(axis=0) + scores[i]
        tag = int((best + self.moves[:, OUTSIDE]).argmax())
        out = np.zeros(len(scores), np.int8)
        for i in range(len(scores) - 1, -1, -1):
            out[i] = tag
            tag = back[i, tag]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

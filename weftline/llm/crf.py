"""Linear-chain conditional random field over named features: training by gradient ascent, batched Viterbi decoding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _padded(rows: Sequence[Sequence[Sequence[int]]], width: int, blank: int) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(r) for r in rows], np.int64)
    out = np.full((len(rows), int(lens.max(initial=1)), width), blank, np.int32)
    for i, r in enumerate(rows):
        for t, features in enumerate(r):
            out[i, t, : len(features)] = features
    return out, lens


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Crf:
    """``names`` maps features to rows of ``weights``; a feature that training never saw weighs nothing."""

    def __init__(self, labels: Sequence[str], names: dict[str, int]):
        self.labels, self.names = list(labels), names
        n = len(self.labels)
        self.weights, self.moves, self.starts = np.zeros((len(names) + 1, n)), np.zeros((n, n)), np.zeros(n)

    @classmethod
    def train(cls, sequences: Sequence[Sequence[Sequence[str]]], tags: Sequence[Sequence[str]], labels: Sequence[str], steps: int = 80, rate: float = 0.2, penalty: float = 1e-3) -> Crf:
        names = {f: i for i, f in enumerate(sorted({f for s in sequences for fs in s for f in fs}))}
        self = cls(labels, names)
        blank = len(names)
        rows = [[[names[f] for f in fs] for fs in s] for s in sequences]
        lens = np.array([len(r) for r in rows], np.int64)
        b, t_max = len(rows), int(lens.max())
        # All features of all tokens in one array, once by token and once by feature, for sums by either.
        cell = np.repeat(np.concatenate([i * t_max + np.arange(k) for i, k in enumerate(lens)]), widths := np.array([len(fs) for r in rows for fs in r]))
        flat = np.array([f for r in rows for fs in r for f in fs], np.int64)
        cells, first_of_cell = cell[np.cumsum(widths) - widths], np.cumsum(widths) - widths
        by_feature = np.argsort(flat, kind="stable")
        first_of_feature = np.searchsorted(flat[by_feature], np.arange(blank))
        n = len(labels)
        code = {c: i for i, c in enumerate(labels)}
        y = np.zeros((b, t_max), np.int64)
        for i, s in enumerate(tags):
            y[i, : len(s)] = [code[c] for c in s]
        mask = np.arange(t_max)[None] < lens[:, None]
        truth = np.eye(n)[y] * mask[..., None]
        pairs = np.zeros((n, n))
        np.add.at(pairs, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1)
        parts = [self.weights, self.moves, self.starts]
        m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        for step in range(1, steps + 1):
            score = np.zeros((b * t_max, n))
            score[cells] = np.add.reduceat(self.weights[flat], first_of_cell, axis=0)
            score = score.reshape(b, t_max, n)
            alpha = np.zeros((b, t_max, n))
            alpha[:, 0] = self.starts + score[:, 0]
            for t in range(1, t_max):
                new = _lse(alpha[:, t - 1, :, None] + self.moves[None], 1) + score[:, t]
                alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
            beta = np.zeros((b, t_max, n))
            for t in range(t_max - 2, -1, -1):
                new = _lse(self.moves[None] + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
            total = _lse(alpha[:, -1], 1)
            at = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
            both = alpha[:, :-1, :, None] + self.moves + (score + beta)[:, 1:, None, :] - total[:, None, None, None]
            both = (np.exp(np.minimum(both, 0)) * mask[:, 1:, None, None]).sum(axis=(0, 1))
            gap = (truth - at).reshape(-1, n)
            up = [np.vstack([np.add.reduceat(gap[cell[by_feature]], first_of_feature, axis=0), np.zeros(n)]), pairs - both, (truth - at)[:, 0].sum(axis=0)]
            for k, p in enumerate(parts):
                g = up[k] / b - penalty * p
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def decode(self, sequences: Sequence[Sequence[Sequence[str]]], cells: int = 60_000) -> list[list[str]]:
        """The likeliest labels of each sequence, by Viterbi over batches of sequences of like length."""
        blank = len(self.names)
        get = self.names.get
        out: list[list[str]] = [[] for _ in sequences]
        order = sorted((i for i, s in enumerate(sequences) if s), key=lambda i: len(sequences[i]))
        k = 0
        while k < len(order):
            longest, end = len(sequences[order[k]]), k + 1
            while end < len(order) and (end - k + 1) * len(sequences[order[end]]) <= cells and len(sequences[order[end]]) <= longest * 1.5 + 4:
                end += 1
            chosen = order[k:end]
            rows = [[[get(f, blank) for f in fs] for fs in sequences[i]] for i in chosen]
            x, lens = _padded(rows, max(len(fs) for r in rows for fs in r), blank)
            score = np.zeros((*x.shape[:2], len(self.labels)))
            for j in range(x.shape[2]):
                score += self.weights[x[:, :, j]]
            best, back = self.starts + score[:, 0], np.zeros(score.shape, np.int8)
            for t in range(1, score.shape[1]):
                options = best[:, :, None] + self.moves[None]
                back[:, t] = options.argmax(axis=1)
                new = options.max(axis=1) + score[:, t]
                best = np.where((t < lens)[:, None], new, best)
            label = best.argmax(axis=1)
            for r, i in enumerate(chosen):
                c, path = int(label[r]), []
                for t in range(int(lens[r]) - 1, -1, -1):
                    path.append(self.labels[c])
                    c = int(back[r, t, c])
                out[i] = path[::-1]
            k = end
        return out

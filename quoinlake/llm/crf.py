"""A linear-chain conditional random field over sparse features, trained in numpy."""

import math
from collections.abc import Hashable, Sequence

import numpy as np


class ChainCRF:
    """Weights of features and of transitions for a few labels; Viterbi decoding."""

    def __init__(self, labels: int = 2):
        self.labels = labels
        self.index: dict[Hashable, int] = {}
        self.weights = np.zeros((0, labels))
        self.start, self.between = np.zeros(labels), np.zeros((labels, labels))

    def fit(
        self, pages: Sequence[Sequence[Sequence[Hashable]]], truth: Sequence[Sequence[int]], rounds: int = 150,
        rate: float = 0.5, l2: float = 1e-5,
    ) -> "ChainCRF":
        """Maximise the conditional likelihood of all pages together by AdaGrad steps."""
        for page in pages:
            for block in page:
                for f in block:
                    self.index.setdefault(f, len(self.index))
        k, n, longest = self.labels, len(pages), max((len(p) for p in pages), default=0)
        flat = [[self.index[f] for f in block] for page in pages for block in page]
        rows = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
        cols = np.array([c for f in flat for c in f], np.int64)
        place = np.array([(i, t) for i, p in enumerate(pages) for t in range(len(p))], np.int64).reshape(-1, 2)
        real = np.zeros((n, longest), bool)
        real[place[:, 0], place[:, 1]] = True
        gold = np.zeros((n, longest), np.int64)
        gold[place[:, 0], place[:, 1]] = [y for page in truth for y in page]
        hot = np.eye(k)[gold] * real[..., None]
        self.weights = np.zeros((len(self.index), k))
        params = [self.weights, self.start, self.between]
        sums = [np.full(p.shape, 1e-8) for p in params]
        want_between = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
        for _ in range(rounds):
            emit = np.zeros((n, longest, k))
            scores = np.zeros((len(flat), k))
            for y in range(k):
                scores[:, y] = np.bincount(rows, self.weights[cols, y], len(flat))
            emit[place[:, 0], place[:, 1]] = scores
            ahead, back = np.zeros_like(emit), np.zeros_like(emit)
            ahead[:, 0] = emit[:, 0] + self.start
            for t in range(1, longest):
                ahead[:, t] = _lse(ahead[:, t - 1, :, None] + self.between, 1) + emit[:, t]
                ahead[:, t] = np.where(real[:, t, None], ahead[:, t], ahead[:, t - 1])
            for t in range(longest - 2, -1, -1):
                step = _lse(self.between + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
                back[:, t] = np.where(real[:, t + 1, None], step, 0.0)
            total = _lse(ahead[:, -1], 1)
            node = np.exp(ahead + back - total[:, None, None]) * real[..., None]
            pair = ahead[:, :-1, :, None] + self.between + (emit[:, 1:] + back[:, 1:])[:, :, None, :]
            pair = np.exp(pair - total[:, None, None, None]) * real[:, 1:, None, None]
            error = (hot - node)[place[:, 0], place[:, 1]]
            down = np.stack([np.bincount(cols, error[rows, y], len(self.index)) for y in range(k)], 1)
            grads = [down, (hot - node)[:, 0].sum(0), want_between - pair.sum((0, 1))]
            for p, g, s in zip(params, grads, sums):
                g = g / n - l2 * p
                s += g * g
                p += rate * g / np.sqrt(s)
        return self

    def score(self, features: Sequence[Hashable]) -> list[float]:
        """Sum of the weights of features; unknown ones count nothing."""
        known = [self.index[f] for f in features if f in self.index]
        return self.weights[known].sum(0).tolist()

    def decode(self, emit: Sequence[Sequence[float]]) -> list[int]:
        """Labels of the best path through the scores of a page's blocks."""
        if not emit:
            return []
        k, between = range(self.labels), self.between.tolist()
        best, links = [s + e for s, e in zip(self.start.tolist(), emit[0])], []
        for row in emit[1:]:
            came = [max(k, key=lambda i, j=j: best[i] + between[i][j]) for j in k]
            best = [best[came[j]] + between[came[j]][j] + row[j] for j in k]
            links.append(came)
        path = [max(k, key=lambda i: best[i])]
        for came in reversed(links):
            path.append(came[path[-1]])
        return path[::-1]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def likelihood(crf: ChainCRF, emit: Sequence[Sequence[float]], path: Sequence[int]) -> float:
    """Log of a path's score, not normalised; for tests."""
    total = crf.start[path[0]] + emit[0][path[0]]
    for a, b, row in zip(path, path[1:], emit[1:]):
        total += crf.between[a, b] + row[b]
    return float(total) if math.isfinite(total) else -math.inf

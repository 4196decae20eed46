"""A factorization machine over sets of hashed terms, trained by proximal AdaGrad with numpy."""

from __future__ import annotations

import numpy as np


class FactorizationMachine:
    """score(S) = sigmoid(b + sum of w_i over S + sum of <v_i, v_j> over pairs of S), S a set of term numbers.

    The pairwise part costs no more than the linear one, since it is half of (sum v)^2 - sum v^2. Soft
    thresholds keep the linear weight of terms that say nothing at zero, so that a long text is not
    judged by the sum of its many indifferent words.
    """

    def __init__(self, size: int, factors: int = 4, seed: int = 5):
        r = np.random.default_rng(seed)
        self.bias, self.linear = 0.0, np.zeros(size, np.float64)
        self.pairs = r.normal(0, 0.02, (size, factors))
        self.seen = np.zeros(size, bool)

    def margins(self, terms: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """One for each set; the sets lie one after the other in `terms`."""
        return self._forward(terms, lengths)[0]

    def _forward(self, terms: np.ndarray, lengths: np.ndarray):
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)

        def sums(x: np.ndarray) -> np.ndarray:
            out = np.zeros((len(lengths), *x.shape[1:]))
            full = lengths > 0
            if full.any():
                out[full] = np.add.reduceat(x, starts[full], axis=0)
            return out

        v = self.pairs[terms]
        total = sums(v)
        return self.bias + sums(self.linear[terms]) + 0.5 * ((total**2).sum(1) - sums((v**2).sum(1))), v, total

    def fit(self, terms: np.ndarray, lengths: np.ndarray, labels: np.ndarray, epochs: int = 15, batch: int = 512, rate: float = 0.5, pair_rate: float = 0.01, sparse: float = 1e-3, decay: float = 1e-3, least: int = 3, seed: int = 5) -> FactorizationMachine:
        """labels: 0 to 1 each. Terms in fewer than `least` training sets keep no weight."""
        r, n = np.random.default_rng(seed), len(labels)
        if not n:
            self.pairs[:] = 0
            return self
        self.seen = np.bincount(terms, minlength=len(self.linear)) >= least
        self.pairs[~self.seen] = 0
        share = float(np.clip(labels.mean(), 1e-4, 1 - 1e-4))
        self.bias = float(np.log(share / (1 - share)))
        ends = np.cumsum(lengths)
        g_lin, g_pair, g_bias = np.full(len(self.linear), 1e-8), np.full(self.pairs.shape, 1e-8), 1e-8
        for _ in range(epochs):
            for rows in np.array_split(r.permutation(n), max(1, n // batch)):
                t = np.concatenate([terms[ends[i] - lengths[i] : ends[i]] for i in rows]) if len(rows) else terms[:0]
                sizes = lengths[rows]
                m, v, total = self._forward(t, sizes)
                error = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - labels[rows]) / len(rows)
                each = np.repeat(error, sizes)
                touched, where = np.unique(t, return_inverse=True)
                live = self.seen[touched]
                lin = np.bincount(where, each, len(touched)) * live
                grad = each[:, None] * (np.repeat(total, sizes, axis=0) - v)
                pair = np.stack([np.bincount(where, grad[:, k], len(touched)) for k in range(v.shape[1])], 1) * live[:, None]
                pair += decay * self.pairs[touched] * live[:, None] / len(rows)
                g_lin[touched] += lin**2
                g_pair[touched] += pair**2
                g_bias += error.sum() ** 2
                step = rate / np.sqrt(g_lin[touched])
                w = self.linear[touched] - step * lin
                self.linear[touched] = np.sign(w) * np.maximum(np.abs(w) - step * sparse, 0) * live
                p = self.pairs[touched] - pair_rate / np.sqrt(g_pair[touched]) * pair
                # the factors of a term that says nothing shrink to nothing as well
                norm = np.linalg.norm(p, axis=1, keepdims=True)
                self.pairs[touched] = p * np.maximum(0, 1 - step[:, None] * sparse * pair_rate / rate / np.maximum(norm, 1e-12))
                self.bias -= rate / np.sqrt(g_bias) * error.sum() * 0.1
        return self

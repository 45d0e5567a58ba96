"""A linear-chain conditional random field over categorical features, in numpy batches.

Each position of a sequence has the same number of active feature indexes.
Sequences of one call are handled together, longest first: step t works on the
prefix of sequences that are longer than t, so that nothing is padded.
"""

from __future__ import annotations

import numpy as np


class Batch:
    """Sequences given by their lengths (each at least 1), rows in order."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, dtype=np.int64)
        starts = np.cumsum(self.lengths) - self.lengths
        order = np.argsort(-self.lengths, kind="stable")
        self.starts, longest = starts[order], self.lengths[order]
        most = int(longest[0]) if len(longest) else 0
        #: of how many sequences position t exists
        self.alive = np.searchsorted(-longest, -np.arange(1, most + 1), side="right")
        self.last = self.starts + longest - 1

    def rows(self, t: int) -> np.ndarray:
        return self.starts[: self.alive[t]] + t


class Crf:
    def __init__(self, n_features: int, n_states: int):
        self.weights = np.zeros((n_features, n_states))
        self.moves = np.zeros((n_states, n_states))
        self.first = np.zeros(n_states)

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = self.weights[features[:, 0]].copy()
        for k in range(1, features.shape[1]):
            out += self.weights[features[:, k]]
        return out

    def marginals(self, emit: np.ndarray, batch: Batch, gather: bool = False):
        """P(state) of each row; with gather also the log partition sum and the expected transitions."""
        top = emit.max(axis=1, keepdims=True)
        local, move = np.exp(emit - top), np.exp(self.moves)
        forward, scale = np.empty_like(local), np.empty(len(local))
        for t in range(len(batch.alive)):
            rows = batch.rows(t)
            x = local[rows] * (forward[rows - 1] @ move if t else np.exp(self.first))
            s = x.sum(axis=1)
            forward[rows], scale[rows] = x / s[:, None], s
        backward = np.ones_like(local)
        pairs = np.zeros_like(move)
        for t in range(len(batch.alive) - 2, -1, -1):
            nxt = batch.rows(t + 1)
            y = local[nxt] * backward[nxt] / scale[nxt][:, None]
            backward[nxt - 1] = y @ move.T
            if gather:
                pairs += (forward[nxt - 1].T @ y) * move
        post = forward * backward
        post /= post.sum(axis=1, keepdims=True)
        return (post, np.log(scale).sum() + top.sum(), pairs) if gather else post

    def viterbi(self, emit: np.ndarray, batch: Batch) -> np.ndarray:
        """The best state of each row; of equal ones the smaller."""
        best, back = emit.copy(), np.zeros(emit.shape, dtype=np.int8)
        for t in range(len(batch.alive)):
            rows = batch.rows(t)
            if not t:
                best[rows] += self.first
                continue
            paths = best[rows - 1][:, :, None] + self.moves[None]
            back[rows] = paths.argmax(axis=1)
            best[rows] += paths.max(axis=1)
        out = np.zeros(len(emit), dtype=np.int64)
        out[batch.last] = best[batch.last].argmax(axis=1)
        for t in range(len(batch.alive) - 2, -1, -1):
            nxt = batch.rows(t + 1)
            out[nxt - 1] = back[nxt, out[nxt]]
        return out

    def fit(self, features: np.ndarray, states: np.ndarray, lengths: np.ndarray, weight: np.ndarray | None = None, rounds: int = 120, rate: float = 0.15, ridge: float = 1e-4) -> Crf:
        """Maximum likelihood with a ridge penalty; full-batch Adam, so the result depends on the rows alone."""
        batch, n, k = Batch(lengths), len(features), self.moves.shape[0]
        starts = np.cumsum(lengths) - lengths
        inner = np.ones(n, dtype=bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        seen = np.zeros((k, k))
        np.add.at(seen, (states[at - 1], states[at]), 1)
        begun = np.bincount(states[starts], minlength=k).astype(float)
        truth = np.eye(k)[states]
        theta = [self.weights, self.moves, self.first]
        mean, var = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
        for step in range(1, rounds + 1):
            post, _, pairs = self.marginals(self.emissions(features), batch, gather=True)
            gap = truth - post
            grad = np.zeros_like(self.weights)
            for c in range(features.shape[1]):
                for s in range(k):
                    grad[:, s] += np.bincount(features[:, c], weights=gap[:, s], minlength=len(grad))
            grads = [grad / n, (seen - pairs) / n, (begun - post[starts].sum(axis=0)) / n]
            for x, g, m, v in zip(theta, grads, mean, var):
                g = g - ridge * x
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x += rate * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

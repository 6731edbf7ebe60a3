"""A bidirectional LSTM and a linear-chain CRF in numpy, with their gradients.

Arrays are (time, batch, features), so a step reads one contiguous slice.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def uniform(rng: np.random.Generator, *shape: int) -> np.ndarray:
    bound = np.sqrt(6 / (shape[0] + shape[-1]))
    return rng.uniform(-bound, bound, shape)


def lstm_params(rng: np.random.Generator, inputs: int, hidden: int, name: str) -> dict[str, np.ndarray]:
    bias = np.zeros(4 * hidden)
    bias[hidden : 2 * hidden] = 1  # forget gates begin open
    return {f"{name}_x": uniform(rng, inputs, 4 * hidden), f"{name}_h": uniform(rng, hidden, 4 * hidden), f"{name}_b": bias}


def lstm(p: dict[str, np.ndarray], name: str, x: np.ndarray, reverse: bool = False, keep: bool = True):
    """Hidden states of all steps, and what the gradient needs."""
    steps, batch, _ = x.shape
    wh = p[f"{name}_h"]
    n = wh.shape[0]
    z = x @ p[f"{name}_x"] + p[f"{name}_b"]
    h, c = np.zeros((batch, n), z.dtype), np.zeros((batch, n), z.dtype)
    out = np.empty((steps, batch, n), z.dtype)
    saved = []
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        a = z[t] + h @ wh
        gates = sigmoid(a[:, : 3 * n])
        g = np.tanh(a[:, 3 * n :])
        before, h_before = c, h
        c = gates[:, n : 2 * n] * c + gates[:, :n] * g
        tc = np.tanh(c)
        h = gates[:, 2 * n :] * tc
        out[t] = h
        if keep:
            saved.append((t, gates, g, before, h_before, tc))
    return out, saved


def lstm_gradient(p: dict[str, np.ndarray], name: str, x: np.ndarray, saved, d_out: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
    """Adds to grads; returns the gradient of x."""
    wh = p[f"{name}_h"]
    n = wh.shape[0]
    d_z = np.empty((*x.shape[:2], 4 * n), x.dtype)
    d_h, d_c = np.zeros((x.shape[1], n), x.dtype), np.zeros((x.shape[1], n), x.dtype)
    d_wh = np.zeros_like(wh)
    for t, gates, g, before, h_before, tc in reversed(saved):
        d_h = d_h + d_out[t]
        i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        d_c = d_c + d_h * o * (1 - tc * tc)
        d = d_z[t]
        d[:, :n] = d_c * g * i * (1 - i)
        d[:, n : 2 * n] = d_c * before * f * (1 - f)
        d[:, 2 * n : 3 * n] = d_h * tc * o * (1 - o)
        d[:, 3 * n :] = d_c * i * (1 - g * g)
        d_wh += h_before.T @ d
        d_h = d @ wh.T
        d_c = d_c * f
    grads[f"{name}_h"] = d_wh
    grads[f"{name}_x"] = np.tensordot(x, d_z, axes=((0, 1), (0, 1)))
    grads[f"{name}_b"] = d_z.sum(axis=(0, 1))
    return d_z @ p[f"{name}_x"].T


def log_sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def crf_loss(scores: np.ndarray, moves: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of the tag sequences, and the gradients of scores and moves."""
    steps, batch, n = scores.shape
    ahead = np.empty_like(scores)
    ahead[0] = scores[0]
    for t in range(1, steps):
        ahead[t] = scores[t] + log_sum_exp(ahead[t - 1][:, :, None] + moves, 1)
    behind = np.zeros_like(scores)
    for t in range(steps - 2, -1, -1):
        behind[t] = log_sum_exp((behind[t + 1] + scores[t + 1])[:, None, :] + moves, 2)
    total = log_sum_exp(ahead[-1], 1)
    d_scores = np.exp(ahead + behind - total[:, None])
    pairs = ahead[:-1][:, :, :, None] + moves + (scores[1:] + behind[1:])[:, :, None, :] - total[:, None, None]
    d_moves = np.exp(pairs).sum(axis=(0, 1))
    t, b = np.arange(steps)[:, None], np.arange(batch)[None, :]
    gold = scores[t, b, tags].sum(axis=0) + moves[tags[:-1], tags[1:]].sum(axis=0)
    d_scores[t, b, tags] -= 1
    np.subtract.at(d_moves, (tags[:-1], tags[1:]), 1)
    return float((total - gold).mean()), d_scores / batch, d_moves / batch


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tag sequences, (time, batch)."""
    steps, batch, _ = scores.shape
    best = scores[0]
    came = np.empty(scores.shape, dtype=np.int8)
    for t in range(1, steps):
        options = best[:, :, None] + moves
        came[t] = options.argmax(axis=1)
        best = options.max(axis=1) + scores[t]
    tags = np.empty((steps, batch), dtype=np.int64)
    tags[-1] = best.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        tags[t - 1] = came[t][np.arange(batch), tags[t]]
    return tags


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], most: float = 5.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, most / (norm + 1e-12))
        for k, g in grads.items():
            g = g * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)

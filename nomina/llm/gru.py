"""Gated recurrent units in numpy: training by backpropagation through time, and inference over many lanes at once."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(x: np.ndarray, u: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
    """x [T, B, 3H]: the input's part of update, reset and candidate; u [H, 3H]; mask [T, B]: 0 keeps the state.

    Returns the states [T, B, H] and what backward() needs."""
    steps, lanes, h3 = x.shape
    n = h3 // 3
    h = np.zeros((lanes, n), x.dtype)
    hs = np.empty((steps, lanes, n), x.dtype)
    saved = []
    for t in range(steps):
        g = h @ u
        zr = sigmoid(x[t, :, : 2 * n] + g[:, : 2 * n])
        z, r = zr[:, :n] * mask[t][:, None], zr[:, n:]
        c = np.tanh(x[t, :, 2 * n :] + r * g[:, 2 * n :])
        saved.append((h, zr, z, c, g[:, 2 * n :]))
        h = h + z * (c - h)
        hs[t] = h
    return hs, (saved, u, mask)


def backward(dhs: np.ndarray, kept: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of x and u from those of all states."""
    saved, u, mask = kept
    steps, lanes, n = dhs.shape
    dx, du, dh = np.empty((steps, lanes, 3 * n), dhs.dtype), np.zeros_like(u), np.zeros((lanes, n), dhs.dtype)
    for t in reversed(range(steps)):
        h, zr, z, c, gc = saved[t]
        dh = dh + dhs[t]
        dc = dh * z * (1 - c * c)
        dz = dh * (c - h) * mask[t][:, None] * zr[:, :n] * (1 - zr[:, :n])
        dr = dc * gc * zr[:, n:] * (1 - zr[:, n:])
        dx[t, :, :n], dx[t, :, n : 2 * n], dx[t, :, 2 * n :] = dz, dr, dc
        dg = np.concatenate([dz, dr, dc * zr[:, n:]], axis=1)
        du += h.T @ dg
        dh = dh * (1 - z) + dg @ u.T
    return dx, du


class Adam:
    """Adam over a dict of arrays, with the gradient's norm clipped."""

    def __init__(self, params: dict, rate: float, clip: float = 5.0, decay: float = 0.0):
        self.params, self.rate, self.clip, self.decay, self.t = params, rate, clip, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict, scale: float = 1.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        by = min(1.0, self.clip / (norm + 1e-12))
        for k, g in grads.items():
            g = g * by
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] *= 1 - self.decay * self.rate * scale
            self.params[k] -= (self.rate * scale * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(g.dtype)


class Lanes:
    """One direction's inference: inputs come from a table [3H, V] by code, lanes lie along the last axis."""

    def __init__(self, rows: np.ndarray, u: np.ndarray):
        n = u.shape[0]
        half = np.concatenate([np.full(2 * n, 0.5), np.ones(n)]).astype(np.float32)
        self.n, self.rows, self.u = n, np.ascontiguousarray(rows * half[:, None], np.float32), np.ascontiguousarray(u.T * half[:, None], np.float32)

    def start(self, lanes: int) -> np.ndarray:
        n = self.n
        self.x, self.g = np.empty((3 * n, lanes), np.float32), np.empty((3 * n, lanes), np.float32)
        return np.zeros((n, lanes), np.float32)

    def step(self, h: np.ndarray, codes: np.ndarray, out: np.ndarray) -> np.ndarray:
        n, x, g = self.n, self.x, self.g
        np.take(self.rows, codes, axis=1, out=x, mode="clip")
        np.matmul(self.u, h, out=g)
        zr, c, gc = x[: 2 * n], x[2 * n :], g[2 * n :]
        zr += g[: 2 * n]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        gc *= zr[n:]
        c += gc
        np.tanh(c, out=c)
        c -= h
        c *= zr[:n]
        np.add(h, c, out=out)
        return out

"""A small bidirectional gated recurrent network in numpy: forward, backpropagation through time, Adam.

Inputs come as gate pre-activations (steps, batch, 3 * hidden): whoever calls
looks them up in a table, which is the input weight matrix of a one-hot input.
Sequences are left-aligned; ``mask`` (steps, batch, 1) is 1 inside them. A
padded step passes the state on unchanged, so both directions start from zero.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(gates: np.ndarray, mask: np.ndarray, u: np.ndarray, reverse: bool):
    """States of every step (steps, batch, hidden), and what the backward pass needs."""
    steps, batch, width = gates.shape
    hidden = width // 3
    state = np.zeros((batch, hidden), gates.dtype)
    states = np.empty((steps, batch, hidden), gates.dtype)
    memory = [None] * steps
    for t in (range(steps - 1, -1, -1) if reverse else range(steps)):
        own = state @ u
        zr = sigmoid(gates[t, :, :2 * hidden] + own[:, :2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        new = np.tanh(gates[t, :, 2 * hidden:] + r * own[:, 2 * hidden:])
        memory[t] = (state, zr, new, own[:, 2 * hidden:])
        state = state + mask[t] * (1 - z) * (new - state)
        states[t] = state
    return states, memory


def backward(d_states: np.ndarray, memory, mask: np.ndarray, u: np.ndarray, reverse: bool):
    """Gradients for the gates (steps, batch, 3 * hidden) and for ``u``."""
    steps, batch, hidden = d_states.shape
    d_gates = np.empty((steps, batch, 3 * hidden), d_states.dtype)
    d_u = np.zeros_like(u)
    carry = np.zeros((batch, hidden), d_states.dtype)
    for t in (range(steps) if reverse else range(steps - 1, -1, -1)):
        state, zr, new, own_new = memory[t]
        z, r = zr[:, :hidden], zr[:, hidden:]
        d = d_states[t] + carry
        keep = mask[t] * (1 - z)
        d_new = d * keep * (1 - new * new)
        d_z = d * mask[t] * (state - new) * z * (1 - z)
        d_r = d_new * own_new * r * (1 - r)
        d_gates[t] = np.concatenate([d_z, d_r, d_new], axis=1)
        d_own = np.concatenate([d_z, d_r, d_new * r], axis=1)
        d_u += state.T @ d_own
        carry = d * (1 - keep) + d_own @ u.T
    return d_gates, d_u


def scatter_rows(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sum ``rows`` by ``index`` into a table of ``size`` rows."""
    order = np.argsort(index, kind="stable")
    index, rows = index[order], rows[order]
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    if len(index):
        first = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
        out[index[first]] = np.add.reduceat(rows, first, axis=0)
    return out


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.01, clip: float = 5.0):
        self.weights, self.rate, self.clip, self.t = weights, rate, clip, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, gradients: dict[str, np.ndarray], rate: float | None = None) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradients.values()))
        scale = min(1.0, self.clip / (norm + 1e-9))
        for k, g in gradients.items():
            g = g * scale
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            m = self.mean[k] / (1 - 0.9 ** self.t)
            v = self.square[k] / (1 - 0.999 ** self.t)
            self.weights[k] -= (rate or self.rate) * m / (np.sqrt(v) + 1e-8)

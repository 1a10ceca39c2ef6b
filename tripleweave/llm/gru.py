"""A bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are one vector per word. Both directions run as one batch of matrices; the forward pass is shared by
training and scoring.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(0.5) * (np.tanh(F32(0.5) * x) + F32(1))


def fresh(inputs: int, hidden: int, attention: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Small random weights."""

    def make(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(F32)

    return {
        "input": make(2, inputs, 3 * hidden),
        "bias": np.zeros((2, 1, 3 * hidden), F32),
        "state": make(2, hidden, 3 * hidden),
        "attend": make(2 * hidden, attention),
        "attend_bias": np.zeros(attention, F32),
        "attend_out": make(attention, 1)[:, 0],
        "out": make(2 * hidden, 1)[:, 0],
        "out_bias": np.full(1, -1, F32),
    }


def forward(p: dict[str, np.ndarray], projected: np.ndarray, mask: np.ndarray, trace: dict | None = None) -> np.ndarray:
    """Logits of windows.

    ``projected`` is (steps, 2, windows, 3 * hidden): the words times ``input`` plus ``bias`` for either
    direction, the second one in reading order too. ``mask`` is (steps, windows), 1 where there is a word.
    """
    steps, _, n, width = projected.shape
    size = width // 3
    states = np.zeros((steps, n, 2 * size), F32)
    h = np.zeros((2, n, size), F32)
    kept = []
    for t in range(steps):
        x = np.stack([projected[t, 0], projected[steps - 1 - t, 1]])
        m = np.stack([mask[t], mask[steps - 1 - t]])[:, :, None]
        a = h @ p["state"]
        gates = _sigmoid(x[..., : 2 * size] + a[..., : 2 * size])
        z, r = gates[..., :size], gates[..., size:]
        c = np.tanh(x[..., 2 * size :] + r * a[..., 2 * size :])
        before = h
        h = before + m * (F32(1) - z) * (c - before)
        states[t, :, :size] = h[0]
        states[steps - 1 - t, :, size:] = h[1]
        if trace is not None:
            kept.append((before, m, z, r, c, a[..., 2 * size :]))
    inner = np.tanh(states @ p["attend"] + p["attend_bias"])
    scores = np.where(mask > 0, inner @ p["attend_out"], F32(-1e9))
    weights = np.exp(scores - scores.max(axis=0)) * mask
    weights /= np.maximum(weights.sum(axis=0), F32(1e-9))
    pooled = np.einsum("tn,tnk->nk", weights, states)
    if trace is not None:
        trace |= {"steps": kept, "states": states, "inner": inner, "weights": weights, "pooled": pooled}
    return pooled @ p["out"] + p["out_bias"][0]


def backward(p: dict[str, np.ndarray], trace: dict, mask: np.ndarray, error: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weights but ``input`` and ``bias``, and of ``projected``, from those of the logits."""
    states, inner, weights, pooled = (trace[k] for k in ("states", "inner", "weights", "pooled"))
    steps, n, both = states.shape
    size = both // 2
    g = {"out": pooled.T @ error, "out_bias": error.sum(keepdims=True)}
    d_pooled = error[:, None] * p["out"]
    d_states = weights[:, :, None] * d_pooled
    d_weights = np.einsum("nk,tnk->tn", d_pooled, states)
    d_scores = weights * (d_weights - (weights * d_weights).sum(axis=0))
    g["attend_out"] = np.einsum("tn,tna->a", d_scores, inner)
    d_inner = d_scores[:, :, None] * p["attend_out"] * (1 - inner**2)
    g["attend"] = np.einsum("tnk,tna->ka", states, d_inner)
    g["attend_bias"] = d_inner.sum(axis=(0, 1))
    d_states = d_states + d_inner @ p["attend"].T
    g["state"] = np.zeros_like(p["state"])
    d_projected = np.zeros((steps, 2, n, 3 * size), F32)
    dh = np.zeros((2, n, size), F32)
    for t in reversed(range(steps)):
        before, m, z, r, c, a = trace["steps"][t]
        dh = dh + np.stack([d_states[t, :, :size], d_states[steps - 1 - t, :, size:]])
        live = dh * m
        dz = live * (before - c) * z * (1 - z)
        dc = live * (1 - z) * (1 - c**2)
        dr = dc * a * r * (1 - r)
        dx = np.concatenate([dz, dr, dc], axis=2)
        da = np.concatenate([dz, dr, dc * r], axis=2)
        d_projected[t, 0] = dx[0]
        d_projected[steps - 1 - t, 1] = dx[1]
        g["state"] += before.transpose(0, 2, 1) @ da
        dh = dh * (1 - m) + live * z + da @ p["state"].transpose(0, 2, 1)
    return g, d_projected


class Adam:
    """Adam steps over a dictionary of arrays."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.rate, self.count = rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in p.items()}
        self.square = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.count += 1
        for k, v in g.items():
            self.mean[k] += F32(0.1) * (v - self.mean[k])
            self.square[k] += F32(0.01) * (v * v - self.square[k])
            mean = self.mean[k] / (1 - 0.9**self.count)
            square = self.square[k] / (1 - 0.99**self.count)
            p[k] -= F32(self.rate) * mean / (np.sqrt(square) + F32(1e-6))

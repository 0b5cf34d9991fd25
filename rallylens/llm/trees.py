"""Binning, small regression trees on bins, and monotone calibration, in numpy."""

from __future__ import annotations

import numpy as np


def quantile_edges(x: np.ndarray, bins: int = 32) -> list[np.ndarray]:
    """Upper edges of the bins of each column."""
    steps = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(x[:, j], steps)) for j in range(x.shape[1])]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.int64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return float(np.log(p / (1 - p)))


def gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def best_cut(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """Gain and position of the best cut of a row of bins; position 0 if none."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gs, hs = g.sum(), h.sum()
    if not len(gl):
        return 0.0, 0
    won = gain(gl, hl, ridge) + gain(gs - gl, hs - hl, ridge) - gain(gs, hs, ridge)
    won = np.where((hl >= least) & (hs - hl >= least), won, 0.0)
    at = int(won.argmax())
    return (float(won[at]), at + 1) if won[at] > 1e-9 else (0.0, 0)


def grow_steps(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """Leaf value per bin of a small tree over one feature's bins."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*best_cut(g[a:b], h[a:b], ridge, least), a, b) for a, b in parts]
        won, at, a, b = max(cuts)
        if not at:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    values = np.zeros(len(g))
    for a, b in parts:
        values[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return values


def isotonic(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: scores and the calibrated values at them."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # first score, last score, weighted sum, weight
    for s, y, w in zip(score[order].tolist(), label[order].tolist(), weight[order].tolist()):
        blocks.append([s, s, y * w, w])
        while len(blocks) > 1 and (blocks[-2][1] == blocks[-1][0] or blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    at = np.array([s for b in blocks for s in (b[0], b[1])])
    value = np.array([b[2] / b[3] for b in blocks for _ in (0, 1)])
    return at, value

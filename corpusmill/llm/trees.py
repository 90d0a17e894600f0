"""Gradient-boosted trees on yes/no features, for models small enough to train on the driver."""

from __future__ import annotations

import numpy as np


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 5, rate: float = 0.3, ridge: float = 2.0, least: float = 2.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature of each inner node, value of each leaf, start) of full trees for the logistic loss.

    x is 0/1 of (rows, features). A level's splits are chosen at once: gradient and curvature sums of all features in all its nodes are two matrix products.
    """
    x = x.astype(np.float32)
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))) if len(y) else 0.0
    score = np.full(len(y), start)
    features, leaves = np.zeros((rounds, 2**depth - 1), np.int32), np.zeros((rounds, 2**depth))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = (y - p).astype(np.float32), (p * (1 - p)).astype(np.float32)
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            n = 2**level
            one_hot = (at[:, None] == np.arange(n)).astype(np.float32)
            g1, h1 = (one_hot * g[:, None]).T @ x, (one_hot * h[:, None]).T @ x
            g_all, h_all = one_hot.T @ g, one_hot.T @ h
            g0, h0 = g_all[:, None] - g1, h_all[:, None] - h1
            gain = g1**2 / (h1 + ridge) + g0**2 / (h0 + ridge)
            gain[(h1 < least) | (h0 < least)] = -1
            best = gain.argmax(1)
            features[t, n - 1 : 2 * n - 1] = best
            at = 2 * at + (x[np.arange(len(y)), best[at]] > 0)
        g_leaf, h_leaf = np.bincount(at, g, 2**depth), np.bincount(at, h, 2**depth)
        leaves[t] = rate * g_leaf / (h_leaf + ridge)
        score = score + leaves[t][at]
    return features, leaves, start


def log_odds(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    """Of 0/1 rows."""
    features, leaves, start = model
    depth, rows = leaves.shape[1].bit_length() - 1, np.arange(len(x))
    out = np.full(len(x), start)
    for f, leaf in zip(features, leaves, strict=True):
        at = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            at = 2 * at + (x[rows, f[2**level - 1 + at]] > 0)
        out += leaf[at]
    return out

"""Small linear models over sparse rows, fitted on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_hinge(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, width: int, cost: float = 1.0, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """Weights (the last one is the bias) of the L2-regularised hinge loss, by dual coordinate descent.

    One dual variable per row, kept in [0, cost]; each step solves its row exactly.
    Ends early when no step of a round violates optimality by more than 0.01.
    """
    weights = np.zeros(width + 1)
    signs = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    alpha = np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for _, v in rows])
    order, dice = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        dice.shuffle(order)
        worst = 0.0
        for i in order:
            index, value = rows[i]
            slope = signs[i] * (weights[index] @ value + weights[width]) - 1
            open_slope = min(slope, 0.0) if alpha[i] <= 0 else max(slope, 0.0) if alpha[i] >= cost else slope
            if open_slope:
                worst = max(worst, abs(open_slope))
                new = min(max(alpha[i] - slope / norms[i], 0.0), cost)
                step = (new - alpha[i]) * signs[i]
                alpha[i] = new
                weights[index] += step * value
                weights[width] += step
        if worst < 0.01:
            break
    return weights


def fit_logistic(rows: list[np.ndarray], extra: np.ndarray, labels: np.ndarray, width: int, penalty: float = 0.3, rounds: int = 200) -> np.ndarray:
    """Weights of a logistic model over indicator rows, then the columns of ``extra``, then the bias.

    Full-batch gradient steps with a rate per coordinate; ``penalty`` is an L2 term over the whole sample.
    """
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    extra = np.column_stack([extra, np.ones(len(rows))]) if extra.size else np.ones((len(rows), 1))
    target = np.asarray(labels, float)
    weights, seen = np.zeros(width + extra.shape[1]), np.full(width + extra.shape[1], 1e-8)
    for _ in range(rounds):
        margin = np.bincount(owner, weights[flat], len(rows)) + extra @ weights[width:]
        error = sigmoid(margin) - target
        slope = np.concatenate([np.bincount(flat, error[owner], width), error @ extra])
        slope[: len(slope) - 1] += penalty * weights[: len(slope) - 1]
        seen += slope * slope
        weights -= 0.5 * slope / np.sqrt(seen)
    return weights


def fit_sigmoid(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b with P(label 1) = sigmoid(a * margin + b), by Newton steps on smoothed targets."""
    labels = np.asarray(labels) > 0
    high, low = (labels.sum() + 1) / (labels.sum() + 2), 1 / ((~labels).sum() + 2)
    target = np.where(labels, high, low)
    design = np.column_stack([margins, np.ones(len(margins))])
    at = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(design @ at)
        curve = design.T @ (design * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, design.T @ (p - target) + 1e-6 * at)
        at = at - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])

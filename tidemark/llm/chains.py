"""Classifier chains: one logistic model per label, each knowing the labels decided before it."""

from __future__ import annotations

import numpy as np


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 25, toward: np.ndarray | None = None) -> np.ndarray:
    """Coefficients (the last one for the constant) by Newton's method with a quadratic penalty.

    Without ``toward`` coefficients are drawn to 0 and the constant is free; with it all of them are drawn to its values, so
    that with no rows at all these come out.
    """
    z = np.hstack([x, np.ones((len(x), 1))])
    centre = np.zeros(z.shape[1]) if toward is None else toward
    ridge = np.full(z.shape[1], penalty)
    if toward is None:
        ridge[-1] = 1e-3
    w = centre.copy()
    for _ in range(rounds):
        p = _sigmoid(z @ w)
        gradient = z.T @ (p - y) + ridge * (w - centre)
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Chain:
    """Label after label in the order of their frequency; each calibrated on rows that its fit didn't see."""

    def __init__(self, labels: int):
        self.labels = labels
        self.order: list[int] = list(range(labels))
        self.weights: list[np.ndarray] = []
        self.scale: list[tuple[float, float]] = []

    @staticmethod
    def _design(x: np.ndarray, own: np.ndarray | None, k: int) -> np.ndarray:
        return x if own is None else np.hstack([x, own[:, k]])

    def fit(self, x: np.ndarray, y: np.ndarray, own: np.ndarray | None = None, folds: int = 4) -> "Chain":
        """``x``: rows x features that all labels see; ``own``: rows x labels x features that only their label sees; ``y``:
        rows x labels of 0 and 1. A label's raw scores of each fold by a fit on the others are put through a logistic,
        drawn to leaving them as they are; the fit on all rows then stands, with that calibration."""
        self.order = sorted(range(self.labels), key=lambda k: (-y[:, k].sum(), k))
        part = np.arange(len(x)) % folds
        for place, k in enumerate(self.order):
            z = np.hstack([self._design(x, own, k), y[:, self.order[:place]]])
            raw = np.zeros(len(x))
            for fold in range(folds):
                w = fit_logistic(z[part != fold], y[part != fold, k])
                raw[part == fold] = z[part == fold] @ w[:-1] + w[-1]
            self.weights.append(fit_logistic(z, y[:, k]))
            a, b = fit_logistic(raw[:, None], y[:, k], 1.0, toward=np.array([1.0, 0.0]))
            self.scale.append((float(max(a, 0.1)), float(b)))
        return self

    def decode(self, x: np.ndarray, own: np.ndarray | None = None, width: int = 8) -> np.ndarray:
        """The likeliest combinations of labels of each row by beam search, the likeliest first: rows x ``width`` (fewer
        where there are fewer combinations) x labels."""
        n = len(x)
        chosen = np.zeros((n, 1, 0))
        score = np.zeros((n, 1))
        for k, w, (a, b) in zip(self.order, self.weights, self.scale):
            z = self._design(x, own, k)
            f = z.shape[1]
            raw = (z @ w[:f])[:, None] + chosen @ w[f:-1] + w[-1]
            p = np.clip(_sigmoid(a * raw + b), 1e-9, 1 - 1e-9)
            both = np.concatenate([score + np.log1p(-p), score + np.log(p)], axis=1)
            beams = score.shape[1]
            best = np.argsort(-both, axis=1, kind="stable")[:, : min(width, 2 * beams)]
            score = np.take_along_axis(both, best, axis=1)
            parents = np.take_along_axis(chosen, (best % beams)[:, :, None], axis=1)
            chosen = np.concatenate([parents, (best >= beams)[:, :, None].astype(float)], axis=2)
        out = np.zeros(chosen.shape, dtype=bool)
        out[:, :, self.order] = chosen > 0
        return out

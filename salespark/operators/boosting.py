"""Boosted trees on the pinball loss, for one series of daily values.

The pinball loss of a quantile q weighs what lies above a prediction by q and what
lies below by 1 - q; its optimum is the conditional quantile.  A round fits a small
tree to the loss's gradient (q above the prediction, q - 1 below) and moves each leaf
by a share of the q-quantile of the residuals in it.  Inputs are cut into bins once,
so a split is found from sums by bin, whatever the number of days.
"""

from __future__ import annotations

import numpy as np

BINS = 64
#: Least days of a leaf.
LEAF_DAYS = 5


def binned(past: np.ndarray, future: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Columns of both as bin numbers (cut at quantiles of the past), and bins a column."""
    cuts = [np.unique(np.quantile(past[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(past.shape[1])]
    a, b = (np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1) for x in (past, future))
    return a, b, [len(c) + 1 for c in cuts]


def boosted(past: np.ndarray, values: np.ndarray, future: np.ndarray, q: float, rounds: int, depth: int,
            rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Predictions of the quantile ``q`` for the past (which trains) and the future."""
    x, ahead, bins = binned(past, future)
    fitted = np.full(len(values), np.quantile(values, q))
    told = np.full(len(future), fitted[0] if len(values) else 0.0)

    def grow(own: np.ndarray, later: np.ndarray, left: int) -> None:
        split = _best_split(x[own], gradient[own], bins) if left else None
        if split is None:
            step = rate * np.quantile(residual[own], q)
            fitted[own] += step
            told[later] += step
            return
        column, cut = split
        low, low_later = x[own, column] <= cut, ahead[later, column] <= cut
        grow(own[low], later[low_later], left - 1)
        grow(own[~low], later[~low_later], left - 1)

    everything = np.arange(len(values)), np.arange(len(future))
    for _ in range(rounds):
        residual = values - fitted
        gradient = np.where(residual > 0, q, q - 1.0)
        grow(*everything, depth)
    return fitted, told


def _best_split(x: np.ndarray, gradient: np.ndarray, bins: list[int]) -> tuple[int, int] | None:
    """(column, last bin on the left) that lowers the squared error most; None if none does."""
    n, total = len(x), gradient.sum()
    best, found = total * total / max(n, 1) + 1e-9, None
    for column, many in enumerate(bins):
        count = np.cumsum(np.bincount(x[:, column], minlength=many))[:-1]
        left = np.cumsum(np.bincount(x[:, column], gradient, minlength=many))[:-1]
        fair = (count >= LEAF_DAYS) & (n - count >= LEAF_DAYS)
        if fair.any():
            gain = np.where(fair, left ** 2 / np.maximum(count, 1) + (total - left) ** 2 / np.maximum(n - count, 1), -1.0)
            at = int(gain.argmax())
            if gain[at] > best:
                best, found = gain[at], (column, at)
    return found

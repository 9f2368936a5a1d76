"""Gradient-boosted trees for two classes, with numpy histograms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES, DEPTH, BINS, RATE, RIDGE = 40, 4, 32, 0.3, 1.0


@dataclass(frozen=True)
class Boosted:
    """Trees of one depth as arrays: the split of node i leads to 2i + 1 (no) and 2i + 2 (yes)."""

    column: np.ndarray
    above: np.ndarray
    leaf: np.ndarray
    base: float

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for column, above, leaf in zip(self.column, self.above, self.leaf):
            at = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (rows[every, column[at]] > above[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boost(rows: np.ndarray, labels: np.ndarray) -> Boosted:
    """Fit by Newton steps on the logistic loss; ties go to the first column and bin."""
    cuts = [
        np.unique(np.quantile(rows[:, c], np.linspace(0, 1, BINS + 1)[1:-1]))
        for c in range(rows.shape[1])
    ]
    binned = np.stack([np.searchsorted(cut, rows[:, c], "left") for c, cut in enumerate(cuts)], 1)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    score = np.full(len(rows), np.log(share / (1 - share)))
    inner = 2**DEPTH - 1
    columns, aboves, leaves = [], [], []
    for _ in range(TREES):
        odds = 1 / (1 + np.exp(-score))
        slope, bend = labels - odds, odds * (1 - odds)
        column, above = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(rows), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            local = at - first
            sums = np.bincount(local, slope, width), np.bincount(local, bend, width)
            gain_before = sums[0] ** 2 / (sums[1] + RIDGE)
            for c, cut in enumerate(cuts):
                if not len(cut):
                    continue
                size = len(cut) + 1
                key = local * size + binned[:, c]
                g = np.bincount(key, slope, width * size).reshape(width, size).cumsum(1)[:, :-1]
                h = np.bincount(key, bend, width * size).reshape(width, size).cumsum(1)[:, :-1]
                rest_g, rest_h = sums[0][:, None] - g, sums[1][:, None] - h
                gain = g**2 / (h + RIDGE) + rest_g**2 / (rest_h + RIDGE) - gain_before[:, None]
                gain[(h < 1e-3) | (rest_h < 1e-3)] = 0
                pick = gain.argmax(1)
                better = gain[np.arange(width), pick] > best + 1e-9
                best = np.where(better, gain[np.arange(width), pick], best)
                column[first : first + width][better] = c
                above[first : first + width][better] = cut[pick[better]]
            at = 2 * at + 1 + (rows[np.arange(len(rows)), column[at]] > above[at])
        leaf_at = at - inner
        leaf = RATE * np.bincount(leaf_at, slope, inner + 1) / (
            np.bincount(leaf_at, bend, inner + 1) + RIDGE
        )
        score += leaf[leaf_at]
        columns.append(column)
        aboves.append(above)
        leaves.append(leaf)
    return Boosted(np.array(columns), np.array(aboves), np.array(leaves), float(np.log(share / (1 - share))))

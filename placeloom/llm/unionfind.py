"""Union-find over arrays, for the links inside one bucket."""

from __future__ import annotations

import numpy as np


def roots(lab: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = lab[x]
    while True:
        up = lab[r]
        if (up == r).all():
            return r
        r = up


def join_sets(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the sets of i[k] and j[k]; lab holds parents, the smaller position is the root."""
    while len(i):
        a, b = roots(lab, i), roots(lab, j)
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))

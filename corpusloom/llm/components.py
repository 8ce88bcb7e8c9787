"""Classes of rows that a task holds; those of distributed links are in operators.graph."""

from __future__ import annotations

import numpy as np

from corpusloom.operators.graph import connected

__all__ = ["connected", "merge", "settle"]

def settle(parent: np.ndarray) -> np.ndarray:
    while True:
        above = parent[parent]
        if np.array_equal(above, parent):
            return parent
        parent = above


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of a[i] and b[i] for all i; parents are the least members."""
    while True:
        parent = settle(parent)
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))

"""The discounts of interpolated modified Kneser-Ney smoothing."""

from __future__ import annotations

import numpy as np


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """What is taken off counts 0, 1, 2 and 3 or more, from the numbers of
    n-grams seen once to four times; the usual constants where one is missing."""
    if not min(n1 or 0, n2 or 0, n3 or 0, n4 or 0):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    found = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(found, 0.0, [0.0, 1.0, 2.0, 3.0])


def taken(counts: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Counts after their discounts."""
    return counts - by[np.minimum(counts, 3).astype(np.int64)]

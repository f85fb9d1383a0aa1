"""Pairs in opposite order, counted over numpy arrays inside a task."""

from __future__ import annotations

import numpy as np


def inversions(x: np.ndarray, y: np.ndarray) -> int:
    """How many pairs have a smaller ``x`` and a greater ``y``: n log n steps along the binary digits of y's ranks.

    Rows lie in the order of x. At each digit they are grouped by the digits above it, kept in order; a row of digit 0 makes a
    pair with every row of digit 1 before it in its group.
    """
    if len(x) < 2:
        return 0
    rank = np.unique(y, return_inverse=True)[1][np.lexsort((y, x))]
    total = 0
    for digit in reversed(range(int(rank.max()).bit_length())):
        group, one = rank >> (digit + 1), (rank >> digit) & 1
        ones = np.cumsum(one)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        before = np.repeat(ones[first] - one[first], np.diff(np.append(first, len(rank))))
        total += int(((ones - before) * (1 - one)).sum())
        rank = rank[np.argsort(rank >> digit, kind="stable")]
    return total


def equal_pairs(*columns: np.ndarray) -> float:
    """How many pairs are equal in all columns."""
    if not len(columns[0]):
        return 0.0
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    n = np.diff(np.append(np.flatnonzero(new), len(order))).astype(float)
    return float((n * (n - 1) / 2).sum())


def opposed_cells(counts: np.ndarray) -> float:
    """Pairs of rows in cells (x, y) of a table of counts, one of a smaller x and a greater y than the other."""
    above = np.cumsum(counts[::-1], axis=0)[::-1] - counts  # greater x, same y
    smaller = np.cumsum(above, axis=1) - above  # greater x, smaller y
    return float((counts.astype(float) * smaller).sum())

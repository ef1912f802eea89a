"""Two-sample Kolmogorov-Smirnov test for the small samples inside one keyed state."""

from __future__ import annotations

import numpy as np


def ks_distance(x: np.ndarray, y: np.ndarray) -> float:
    both = np.concatenate([x, y])
    fx = np.searchsorted(np.sort(x), both, side="right") / len(x)
    fy = np.searchsorted(np.sort(y), both, side="right") / len(y)
    return float(np.max(np.abs(fx - fy)))


def ks_p_value(d: float, n: int, m: int) -> float:
    """Exact P(D >= d): one minus the share of lattice paths that stay closer than ``d`` to the diagonal.

    Paths are counted row by row of the shorter sample; a row is a running sum inside the band, and the
    factor ``i / (i + m)`` per row turns the counts into shares at the end.
    """
    if n > m:
        n, m = m, n
    if d <= 0:
        return 1.0
    limit = d - 1e-9
    columns = np.arange(m + 1) / m
    inside = (columns < limit).astype(float)
    for i in range(1, n + 1):
        band = np.abs(i / n - columns) < limit
        inside = np.cumsum(np.where(band, inside, 0.0)) * band * (i / (i + m))
    return float(min(1.0, max(0.0, 1.0 - inside[m])))


def ks_min_p_value(x: np.ndarray, y: np.ndarray) -> float:
    """Smallest p-value over the columns of two row samples."""
    return min(ks_p_value(ks_distance(x[:, c], y[:, c]), len(x), len(y)) for c in range(x.shape[1]))


def ks_p_values(distances: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    """``ks_p_value`` of many distances at once, each between ``n`` values and ``sizes`` (at least ``n``) others.

    Row i of the lattice only needs the columns inside the widest band around the diagonal.
    """
    m = sizes[:, None].astype(float)
    limit = distances[:, None] - 1e-9
    top = int(sizes.max())
    inside = ((np.arange(top + 1) / m < limit) & (np.arange(top + 1) <= m)).astype(float)
    reach = float(distances.max())
    for i in range(1, n + 1):
        low = max(0, int(np.floor((i / n - reach) * sizes.min())) - 1)
        high = min(top, int(np.ceil((i / n + reach) * top)) + 1)
        columns = np.arange(low, high + 1)
        band = (np.abs(i / n - columns / m) < limit) & (columns <= m)
        part = np.cumsum(np.where(band, inside[:, low : high + 1], 0.0), axis=1) * band * (i / (i + m))
        inside[:] = 0.0
        inside[:, low : high + 1] = part
    p = 1.0 - inside[np.arange(len(sizes)), sizes]
    return np.where(distances <= 0, 1.0, np.clip(p, 0.0, 1.0))

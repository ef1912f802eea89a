"""Kernel similarity and sliced Wasserstein distance of micro-batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


TILE = 512  # rows of a batch whose kernel values are held at once


def squared_distances(a: np.ndarray, low: int) -> np.ndarray:
    """Squared distances of the rows from ``low`` on, a tile of them, to all rows."""
    out = np.zeros((len(a[low : low + TILE]), len(a)))
    for column in a.T:
        gap = np.subtract.outer(column[low : low + TILE], column)
        gap *= gap
        out += gap
    return out


def middle_distance(a: np.ndarray, few: int = 1 << 20) -> float:
    """Median of the squared distances that are not 0, by counting in ever finer bins over the tiles; up to ``few`` pairs are held."""
    tiles = range(0, len(a), TILE)
    if len(a) * (len(a) - 1) // 2 <= few:  # each pair once: both halves of the matrix have the same median
        pairs = np.concatenate([row[t + i + 1 :] for t in tiles for i, row in enumerate(squared_distances(a, t))])
        pairs = pairs[pairs != 0]
        ends = [(len(pairs) - 1) // 2, len(pairs) // 2]
        return float(np.partition(pairs, ends)[ends].sum() / 2) if len(pairs) else float("nan")
    low, high, count = np.inf, 0.0, 0
    for t in tiles:
        d = squared_distances(a, t)
        d = d[d != 0]
        count += len(d)
        if len(d):
            low, high = min(low, d.min()), max(high, d.max())
    if not count:
        return float("nan")
    ends = [(count - 1) // 2, count // 2]
    before, inside = 0, count
    while inside > few and high > low:
        edges = np.linspace(low, high, 4097)
        counts = np.zeros(4096, dtype=np.int64)
        for t in tiles:
            d = squared_distances(a, t).ravel()
            counts += np.histogram(d[(d != 0) & (d >= low) & (d <= high)], edges)[0]
        upto = before + np.cumsum(counts)
        first, last = np.searchsorted(upto, ends[0], side="right"), np.searchsorted(upto, ends[1], side="right")
        shrunk = int(counts[first : last + 1].sum())
        before, low, high = before + int(counts[:first].sum()), edges[first], edges[last + 1]
        if shrunk >= inside:
            break
        inside = shrunk
    held = []
    for t in tiles:
        d = squared_distances(a, t).ravel()
        held.append(d[(d != 0) & (d >= low) & (d <= high)])
    values = np.sort(np.concatenate(held))
    below = sum(int(((d := squared_distances(a, t)) != 0).sum() - (d >= low)[d != 0].sum()) for t in tiles)
    return float((values[ends[0] - below] + values[ends[1] - below]) / 2)


def kernel_sums(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Inner products xy, xx, yy of the two centred kernel matrices.

    Centring takes row means off; so sums of products and of row sums are enough, and they add up tile by tile.
    """
    n = len(x)
    width = [middle_distance(a) for a in (x, y)]
    rows = np.empty((2, n))
    products = np.zeros(3)
    for t in range(0, n, TILE):
        kx, ky = (np.exp(-0.5 * squared_distances(a, t) / w) for a, w in zip((x, y), width, strict=True))
        rows[0, t : t + TILE], rows[1, t : t + TILE] = kx.sum(axis=1), ky.sum(axis=1)
        products += [(kx * ky).sum(), (kx * kx).sum(), (ky * ky).sum()]
    out = []
    for value, (i, j) in zip(products, ((0, 1), (0, 0), (1, 1)), strict=True):
        out.append(float(value - 2 * (rows[i] @ rows[j]) / n + rows[i].sum() * rows[j].sum() / n**2))
    return tuple(out)


def kernel_cka(df: DataFrame, x: Sequence[str], y: Sequence[str], *, batch: str = "batch_id") -> DataFrame:
    """Gaussian-kernel similarity of two representations per micro-batch.

    A kernel needs all row pairs of its batch; they are summed in tiles of a few rows against the batch, so the memory
    grows with the batch, not with its square, and no pairs leave the task.
    """
    schema = T.StructType([df.schema[batch], T.StructField("cka", T.DoubleType())])
    x, y = list(x), list(y)

    def similarity(rows: pd.DataFrame) -> pd.DataFrame:
        xy, xx, yy = kernel_sums(*(rows[c].to_numpy(dtype=float) for c in (x, y)))
        with np.errstate(invalid="ignore", divide="ignore"):
            return pd.DataFrame({batch: [rows[batch].iloc[0]], "cka": [xy / np.sqrt(np.float64(xx * yy))]})

    # Pairs cost time, not bytes: keep the configured parallelism where sizes alone would merge tasks.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(batch, *dict.fromkeys([*x, *y])).repartition(tasks, batch).groupBy(batch).applyInPandas(similarity, schema)


def unit_directions(slices: int, dim: int, seed: int) -> np.ndarray:
    rand = np.random.default_rng(seed).normal(size=(slices, dim))
    return rand / np.linalg.norm(rand, axis=1, keepdims=True)


def sliced_wasserstein(
    df: DataFrame,
    features: Sequence[str],
    *,
    batch: str = "batch_id",
    row: str = "seq",
    slices: int = 50,
    shape: str = "uniform",
    seed: int = 0,
) -> DataFrame:
    """Mean squared rank difference between each batch and a prior sample, over random directions.

    The prior's rows (``uniform`` on [-1, 1], ``gaussian`` or ``log-normal``) are derived from the row ids. A batch is shuffled
    once with its features; its task projects both sides on all directions and sorts them as two matrices.
    """
    features = list(features)
    theta = unit_directions(slices, len(features), seed)
    u = [
        f"(pmod(xxhash64({seed}, {i}, {row}), 9007199254740992L) + 0.5D) / 9007199254740992D" for i in range(len(features))
    ]
    v = [
        f"(pmod(xxhash64({seed + 1}, {i}, {row}), 9007199254740992L) + 0.5D) / 9007199254740992D"
        for i in range(len(features))
    ]
    normal = [f"sqrt(-2D * ln({a})) * cos(2D * pi() * {b})" for a, b in zip(u, v, strict=True)]
    prior = {
        "uniform": [f"2D * {a} - 1D" for a in u],
        "gaussian": normal,
        "log-normal": [f"exp({n})" for n in normal],
    }[shape]
    with_prior = df.selectExpr(batch, *features, *[f"{p} AS _z{i}" for i, p in enumerate(prior)])

    z = [f"_z{i}" for i in range(len(features))]
    schema = T.StructType([df.schema[batch], T.StructField("distance", T.DoubleType())])

    def distance(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [np.sort(rows[c].to_numpy(dtype=float) @ theta.T, axis=0) for c in (features, z)]
        return pd.DataFrame({batch: [rows[batch].iloc[0]], "distance": [float(((sides[0] - sides[1]) ** 2).mean())]})

    return with_prior.groupBy(batch).applyInPandas(distance, schema)

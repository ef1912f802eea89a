"""Small dense algebra from distributed sums: moments, principal axes, similarity and projections.

Only ``d x d`` numbers reach the driver (``d`` features); rows never do.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Row count, sums and cross-product sums of a feature table; adding two merges the tables."""

    n: float
    total: np.ndarray
    cross: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.total + other.total, self.cross + other.cross)

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n

    @property
    def covariance(self) -> np.ndarray:
        return self.cross / self.n - np.outer(self.mean, self.mean)


def moments(df: DataFrame, features: Sequence[str], *, group: Sequence[str] = ()) -> dict[tuple, Moments]:
    """Moments per group (few groups: models or clusters, never keys of the data).

    Sums are taken around a rough centre so that large offsets do not cancel.
    """
    features = list(features)
    d = len(features)
    centre = np.array(df.agg(*[F.avg(f) for f in features]).first(), dtype=float)
    x = [F.col(f).cast("double") - F.lit(float(c)) for f, c in zip(features, centre, strict=True)]
    aggregates = [F.count("*").alias("n")]
    aggregates += [F.sum(x[i]).alias(f"t{i}") for i in range(d)]
    aggregates += [F.sum(x[i] * x[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    found = {}
    for row in df.na.drop(subset=features).groupBy(*group).agg(*aggregates).collect():
        n = float(row["n"])
        t = np.array([row[f"t{i}"] for i in range(d)])
        c = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                c[i, j] = c[j, i] = row[f"c{i}_{j}"]
        total = t + n * centre
        cross = c + np.outer(t, centre) + np.outer(centre, t) + n * np.outer(centre, centre)
        found[tuple(row[g] for g in group)] = Moments(n, total, cross)
    return found


def dot(features: Sequence[str], weights: Sequence[float], offset: float = 0.0) -> str:
    """SQL of a linear form."""
    parts = [f"{float(w)!r}D * {f}" for f, w in zip(features, weights, strict=True)]
    return "(" + " + ".join([*parts, f"{float(offset)!r}D"]) + ")"


def principal_axes(m: Moments, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` leading axes (rows) and all variances, largest first."""
    values, vectors = np.linalg.eigh(m.covariance)
    order = np.argsort(values)[::-1]
    return vectors[:, order[:k]].T, np.maximum(values[order], 0.0)


def reconstruction_error(features: Sequence[str], m: Moments, axes: np.ndarray) -> str:
    """SQL: mean squared error of rebuilding a row from its coordinates on ``axes``."""
    mean = m.mean
    coordinates = [dot(features, axis, -float(axis @ mean)) for axis in axes]
    squares = []
    for i, f in enumerate(features):
        rebuilt = " + ".join(f"{float(axis[i])!r}D * {c}" for axis, c in zip(axes, coordinates, strict=True))
        squares.append(f"pow({f} - {float(mean[i])!r}D - ({rebuilt}), 2)")
    return f"(({' + '.join(squares)}) / {len(features)})"


def linear_cka(df: DataFrame, x: Sequence[str], y: Sequence[str], *, group: Sequence[str] = ()) -> DataFrame:
    """Linear similarity of two representations of the same rows, from feature covariances.

    The row-by-row Gram matrices have the same inner products as the d x d cross-covariances, so nothing
    larger is built. Constant features have no similarity (NaN).
    """

    def hsic(a: Sequence[str], b: Sequence[str]) -> Column:
        total = F.lit(0.0)
        for p in a:
            for q in b:
                c = F.covar_pop(F.col(p).cast("double"), F.col(q).cast("double")) * F.count("*")
                total = total + c * c
        return total

    found = df.groupBy(*group).agg(hsic(x, y).alias("hsic_xy"), hsic(x, x).alias("hsic_xx"), hsic(y, y).alias("hsic_yy"))
    size = F.sqrt(F.col("hsic_xx") * F.col("hsic_yy"))
    return found.withColumn("cka", F.when(size == 0, float("nan")).otherwise(F.try_divide(F.col("hsic_xy"), size)))


def residual_distances(df: DataFrame, residuals: Sequence[str]) -> DataFrame:
    """Plain (``sap``) and whitened (``nap``) size of each residual row over the whole table."""
    m = moments(df, residuals)[()]
    values, vectors = np.linalg.eigh(m.covariance)
    terms = []
    for value, axis in zip(values, vectors.T, strict=True):
        scale = m.n * value if value > 1e-12 * max(values.max(), 1e-300) else 1.0
        terms.append(f"pow({dot(residuals, axis, -float(axis @ m.mean))}, 2) / {float(scale)!r}D")
    plain = " + ".join(f"pow({f}, 2)" for f in residuals)
    return df.selectExpr("*", f"({plain}) AS sap", f"sqrt({' + '.join(terms)}) AS nap")

"""Scalar expressions: statistics of decayed sums and numeric clean-up.

The statistics are SQL texts (they are used hundreds at a time); the clean-up helpers are columns.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.schema import PAIR_FLOOR, WEIGHT_FLOOR

# Relative size below which a difference of two square means is rounding noise.
CANCELLATION = 1e-12


def decay_tag(rate: float) -> str:
    """Column-safe label of a decay rate: 5, 0p1, 0p01."""
    return f"{rate:g}".replace(".", "p")


def mean_sql(w: str, s: str) -> str:
    return f"CASE WHEN {w} < {WEIGHT_FLOOR!r}D THEN 0D ELSE {s} / {w} END"


def var_sql(w: str, s: str, ss: str) -> str:
    """``|ss/w - mean**2|``, with differences below rounding noise read as 0."""
    gap = f"abs({ss} / {w} - ({s} / {w}) * ({s} / {w}))"
    return f"CASE WHEN {w} < {WEIGHT_FLOOR!r}D OR {gap} <= {CANCELLATION!r}D * {ss} / {w} THEN 0D ELSE {gap} END"


def magnitude_sql(a: str, b: str) -> str:
    return f"sqrt(({a}) * ({a}) + ({b}) * ({b}))"


def covariance_sql(residual: str, total: str) -> str:
    return f"CASE WHEN {total} < {PAIR_FLOOR!r}D THEN 0D ELSE {residual} / {total} END"


def correlation_sql(cov: str, spread: str) -> str:
    return f"CASE WHEN {spread} < {PAIR_FLOOR!r}D THEN 0D ELSE {cov} / {spread} END"


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def finite_or(column, other: float) -> Column:
    """Replace null, NaN and infinities by ``other``."""
    c = _col(column).cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(float(other))).otherwise(c)


def clip(column, limit: float) -> Column:
    return F.greatest(F.least(_col(column), F.lit(float(limit))), F.lit(-float(limit)))


def cap_infinite(column) -> Column:
    """Positive infinity becomes the largest double, as in the run summaries."""
    c = _col(column)
    return F.when(c == F.lit(float("inf")), F.lit(sys.float_info.max)).otherwise(c)


def squeeze(column, precision: int) -> Column:
    """Decimal rounding, halves to even."""
    return F.bround(_col(column), precision)


def quantize(column, bits: int) -> Column:
    """Uniform rounding to ``2**bits - 1`` steps per unit, halves to even."""
    steps = float(2**bits - 1)
    return F.rint(_col(column) * F.lit(steps)) / F.lit(steps)


def ratio_or(numerator, denominator, other: float) -> Column:
    """Quotient, or ``other`` where the denominator is 0."""
    d = _col(denominator)
    return F.when(d == 0, F.lit(float(other))).otherwise(_col(numerator) / d)


def stable_rank(seed: int, *columns) -> Column:
    """A seeded pseudo-random ordering key that any engine with md5 can recompute."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_col(c).cast("string") for c in columns]).cast("binary"))

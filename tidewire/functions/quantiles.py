"""Exact quantiles of unbounded groups, threshold rules and mergeable states."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.index import heavy_join, running_totals
from tidewire.session import settle

ACCURACY = 10_000


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], *, group: Sequence[str] = (), out: str = "q", few: bool = False) -> DataFrame:
    """Interpolated quantiles (``out0``, ``out1``, ...) per group, exact for groups of any size.

    A bounded sketch first brackets each wanted rank within ``2/ACCURACY`` of the rows; one more pass counts
    the rows below the bracket and the distinct values inside it, so no task ever holds a whole group. ``few`` says that the groups
    are a short list (features), whose brackets are broadcast; else a group that holds much of the rows is dealt (``heavy_join``).
    """
    group = list(group)
    rows = df.where(F.col(value).isNotNull()).withColumn("_one", F.lit(0))
    keys = [*group, "_one"]
    margin = 2.0 / ACCURACY
    wanted = [w for p in probs for w in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx(value, wanted, ACCURACY).alias("_b")
    )
    short = few or not group
    if not short:
        sketch = settle(sketch)
    brackets = sketch.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("i"),
                        (F.lit(float(p)) * (F.col("_n") - 1)).alias("rank"),
                        F.when(F.col("_n") <= ACCURACY, F.lit(float("-inf"))).otherwise(F.col("_b")[2 * i]).alias("lo"),
                        F.when(F.col("_n") <= ACCURACY, F.lit(float("inf"))).otherwise(F.col("_b")[2 * i + 1]).alias("hi"),
                    )
                    for i, p in enumerate(probs)
                ]
            )
        ).alias("b"),
    ).select(*keys, "b.*")
    packed = brackets.groupBy(*keys).agg(F.collect_list(F.struct("i", "rank", "lo", "hi")).alias("_all"))
    if short:
        bracketed = rows.join(F.broadcast(packed), on=keys)  # one row, or a short list
    else:
        bracketed = heavy_join(rows, packed, keys, spread=[F.monotonically_increasing_id()], counts=sketch)
    v = F.col(value).cast("double")
    counted = (
        bracketed.select(*keys, v.alias("_v"), F.explode("_all").alias("b"))
        .where(F.col("_v") <= F.col("b.hi"))
        .groupBy(
            *keys, F.col("b.i").alias("i"), F.col("b.rank").alias("rank"),
            F.when(F.col("_v") >= F.col("b.lo"), F.col("_v")).alias("_v"),
        )
        .agg(F.count("*").alias("_c"))
    )
    cumulated = running_totals(counted, ["_c"], [F.asc_nulls_first("_v")], stream=[*keys, "i", "rank"]).withColumnRenamed("_c_upto", "_cum")
    low, high = F.floor("rank"), F.ceil("rank")
    picked = cumulated.groupBy(*keys, "i", "rank").agg(
        F.min(F.when(F.col("_cum") > low, F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_cum") > high, F.col("_v"))).alias("_b"),
    )
    return picked.groupBy(*keys).agg(
        *[
            F.max(
                F.when(F.col("i") == i, F.col("_a") + (F.col("rank") - low) * (F.col("_b") - F.col("_a")))
            ).alias(f"{out}{i}")
            for i in range(len(probs))
        ]
    ).drop("_one")


def quantile_threshold(df: DataFrame, value: str, p: float, *, group: Sequence[str] = ()) -> DataFrame:
    """Empirical quantile."""
    return exact_quantiles(df, value, [p], group=group, out="_t").withColumnRenamed("_t0", "threshold")


def normal_quantile(value: str | Column, p: float) -> Column:
    """Aggregate: quantile of a normal distribution with the group's mean and population deviation."""
    c = F.col(value) if isinstance(value, str) else value
    return F.avg(c) + F.lit(NormalDist().inv_cdf(p)) * F.stddev_pop(c)


def log_normal_quantile(value: str, p: float) -> Column:
    """Aggregate: as ``normal_quantile`` on the logarithm."""
    return F.exp(normal_quantile(F.log(F.col(value) + F.lit(1e-6)), p))


def quantile_state(df: DataFrame, features: Sequence[str], *, group: Sequence[str] = ()) -> DataFrame:
    """The distinct values of every feature with their counts as a table: (group, feature, value, n).

    An exact state that can be stored and merged; it never has more rows than the data and is counted before the
    shuffle.
    """
    entries = ", ".join(f"named_struct('feature', '{f}', 'value', cast({f} AS double))" for f in features)
    rows = df.selectExpr(*group, f"inline(array({entries}))").where("value IS NOT NULL")
    return rows.groupBy(*group, "feature", "value").agg(F.count("*").alias("n"))


def merge_states(states: DataFrame, *, group: Sequence[str] = ()) -> DataFrame:
    return states.groupBy(*group, "feature", "value").agg(F.sum("n").alias("n"))


def state_quantiles(states: DataFrame, probs: Sequence[float], *, group: Sequence[str] = ()) -> DataFrame:
    """Quantiles ``q0``, ``q1``, ... per (group, feature): the smallest value that so many rows do not exceed."""
    keys = [*group, "feature"]
    rows = states.groupBy(*keys).agg(F.sum("n").alias("rows"))
    steps = running_totals(states.select(*keys, "value", "n"), ["n"], ["value"], stream=keys).join(rows, on=keys)
    return steps.groupBy(*keys, "rows").agg(
        *[F.min(F.when(F.col("n_upto") >= F.lit(float(p)) * F.col("rows"), F.col("value"))).alias(f"q{i}") for i, p in enumerate(probs)]
    )

"""Scaling against running or reference quantiles, two-sample tests and samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.columns import clip, finite_or, stable_rank
from tidewire.functions.quantiles import exact_quantiles, quantile_state
from tidewire.operators.graph import sample_per_group
from tidewire.operators.index import heavy_join, running_totals
from tidewire.schema import CONCEPT_MAX_ROWS, SCALE_LIMIT, SCALE_QUANTILES
from tidewire.session import cut, settle


def batch_state(df: DataFrame, features: Sequence[str], *, by: Sequence[str] = ()) -> DataFrame:
    """The values of every feature with their counts: an exact, mergeable state (see ``quantile_state``)."""
    return quantile_state(df, features, group=by)


def earlier_batches(
    df: DataFrame,
    features: Sequence[str],
    *,
    batch: str = "batch_id",
    stream: Sequence[str] = (),
    probs: Sequence[float] = SCALE_QUANTILES,
    own_first: bool = True,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Exact quantiles, mean and count of every feature over all batches before each batch.

    A wanted quantile is the k-th smallest of the earlier rows. Rows are dealt by value into parts of about ``PART_ROWS``
    rows; from counts per part and batch every batch learns in which part its k-th row lies (one round for each ``BITS`` bits of
    the part's number, none for a single part), and a part answers all batches that ask it at once. So a row is
    moved once or twice, no task holds more than a part, and what a batch carries is three numbers per feature. Columns:
    ``{f}_q0..``, ``{f}_mean``, ``{f}_n``. With ``own_first`` a batch that
    has none before it reads its own quantiles. Every stream continues from ``initial``, a ``batch_state``, if given;
    it is counted once for all streams.
    """
    stream = list(stream)
    keys = [*stream, "feature"]
    entries = ", ".join(f"named_struct('feature', '{f}', 'v', cast({f} AS double))" for f in features)
    wide = settle(df.select(*stream, F.col(batch).alias("_batch"), *features))
    rows = wide.selectExpr(*stream, "_batch", f"inline(array({entries}))").where("v IS NOT NULL")
    rows = rows.withColumn("w", F.lit(1).cast("long")).withColumn("saved", F.lit(False))
    if initial is not None:
        saved = initial.select("feature", F.col("value").alias("v"), F.col("n").alias("w"), F.lit(True).alias("saved"))
        rows = rows.unionByName(saved, allowMissingColumns=True)
    own, kept = rows.where("NOT saved"), rows.where("saved").select("feature", "w", "v")

    # How many rows, and which sum, came before each batch.
    every = wide.select(*stream, "_batch").distinct().select("*", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    sums = own.groupBy(*keys, "_batch").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    filled = every.join(sums, on=[*keys, "_batch"], how="left").fillna(0, ["n", "s"])
    totals = _batch_totals(filled, ["n", "s"], keys).selectExpr(*keys, "_batch", "n", "n_upto - n AS before", "s_upto - s AS before_s")
    start = kept.groupBy("feature").agg(F.sum("w").alias("_n"), F.sum(F.col("v") * F.col("w")).alias("_s"))
    totals = settle(
        totals.join(start, "feature", "left").selectExpr(
            *keys, "_batch", "n", "before + coalesce(_n, 0) AS before", "before_s + coalesce(_s, 0D) AS before_s"
        )
    )
    include = F.col("before") == 0 if own_first else F.lit(False)
    size = F.when(include, F.col("n")).otherwise(F.col("before"))
    queries = totals.select(
        *keys, "_batch", include.alias("own"), size.alias("size"), F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("q", "p")
    ).where("size > 0")
    queries = queries.select(*keys, "_batch", "own", "q", F.greatest(F.ceil(F.col("p") * F.col("size")) - 1, F.lit(0)).cast("long").alias("k"))
    answers = _kth_values(rows, queries, totals.agg(F.sum("n").alias("n")).first()["n"], keys)
    picked = answers.groupBy(*stream, "_batch").agg(
        *[F.max(F.when((F.col("feature") == f) & (F.col("q") == i), F.col("v"))).alias(f"{f}_q{i}") for f in features for i in range(len(probs))]
    )
    means = totals.groupBy(*stream, "_batch").agg(
        *[
            column
            for f in features
            for column in (
                F.max(F.when(F.col("feature") == f, F.try_divide("before_s", "before"))).alias(f"{f}_mean"),
                F.max(F.when(F.col("feature") == f, F.col("before"))).alias(f"{f}_n"),
            )
        ]
    )
    out = means.join(picked, on=[*stream, "_batch"], how="left")
    return out.select(
        *stream,
        F.col("_batch").alias(batch),
        *[f"{f}_q{i}" for f in features for i in range(len(probs))],
        *[c for f in features for c in (f"{f}_mean", f"{f}_n")],
    )


PART_ROWS = 1 << 19  # rows of a part: about 150 MB of a task's Python, and an executor runs several tasks
PIECE_QUERIES = 1_000_000  # questions a copy of a part answers
BITS = 5  # bits of the part's number per round of the search
BLOCK = 4096  # batches of a block; a window holds the batches of one block or the blocks of one stream


def _batch_totals(table: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Running sums (including the row) over ``_batch`` per key, by blocks of batches."""
    blocked = table.withColumn("_block", F.floor(F.col("_batch") / BLOCK))
    inside = Window.partitionBy(*keys, "_block").orderBy("_batch").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy(*keys, "_block").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(names)])
    shifts = blocks.select(*keys, "_block", *[F.coalesce(F.sum(f"_t{i}").over(ahead), F.lit(0)).alias(f"_a{i}") for i in range(len(names))])
    summed = blocked.select("*", *[F.sum(c).over(inside).alias(f"_s{i}") for i, c in enumerate(names)])
    return summed.join(shifts, [*keys, "_block"]).select(
        *table.columns, *[(F.col(f"_s{i}") + F.col(f"_a{i}")).alias(f"{c}_upto") for i, c in enumerate(names)]
    )


def _kth_values(rows: DataFrame, queries: DataFrame, count: int | None, keys: Sequence[str]) -> DataFrame:
    """``queries`` (keys, _batch, own, q, k) with ``v``, their k-th smallest value among the earlier rows of ``rows``."""
    stream = [c for c in keys if c != "feature"]
    size = (count or 0) + rows.where("saved").count()  # saved rows are an empty relation where no state is given
    parts = max(1, -(-size // PART_ROWS))
    if parts == 1:
        placed, asked = rows.withColumn("part", F.lit(0).cast("long")), queries.withColumn("part", F.lit(0).cast("long"))
    else:
        # Equal values may lie in several parts, so a frequent value does not fill one.
        order = ["feature", "v", "_batch", *stream]
        placed = cut(rows.repartitionByRange(parts, *order)).withColumn("part", F.spark_partition_id().cast("long"))
        per_part = placed.groupBy(*keys, "part", "_batch", "saved").agg(F.sum("w").alias("w"))
        counts = settle(per_part)
        started = queries.withColumn("node", F.lit(0).cast("long"))
        asked = _kth_parts(counts.where("NOT saved"), counts.where("saved"), parts, started, keys).withColumnRenamed("node", "part")
    # All quantiles of a feature are asked in few parts; a part with many questions is copied.
    pieces = asked.groupBy("feature", "part").agg(F.ceil(F.count("*") / PIECE_QUERIES).alias("pieces"))
    place = ["feature", "part", "piece"]
    data = placed.join(pieces, ["feature", "part"]).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    dealt = asked.join(pieces, ["feature", "part"]).withColumn("piece", F.pmod(F.xxhash64(*stream, "_batch"), F.col("pieces")))
    schema = dealt.select(*keys, "_batch", "q").schema.add("v", "double")

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        fixed = left[left["saved"]]
        own, found = left[~left["saved"]], []
        by = {}
        if stream:
            by = {key if isinstance(key, tuple) else (key,): rows for key, rows in own.groupby(stream, dropna=False)}
        for key, wanted in right.groupby(stream, dropna=False) if stream else [((), right)]:
            mine = by.get(key if isinstance(key, tuple) else (key,), own[:0]) if stream else own
            values = kth_of_prefixes(
                mine["v"].to_numpy(float), mine["_batch"].to_numpy("int64"), fixed["v"].to_numpy(float), fixed["w"].to_numpy("int64"),
                wanted["_batch"].to_numpy("int64"), wanted["own"].to_numpy(bool), wanted["k"].to_numpy("int64"),
            )
            found.append(wanted[[*keys, "_batch", "q"]].assign(v=values))
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in schema.fieldNames()})

    chosen = data.select(*keys, "part", "piece", "_batch", "v", "w", "saved").groupBy(*place)
    return chosen.cogroup(dealt.select(*keys, "part", "piece", "_batch", "own", "q", "k").groupBy(*place)).applyInPandas(answer, schema)


def kth_of_prefixes(
    values: np.ndarray, batches: np.ndarray, fixed: np.ndarray, weights: np.ndarray, asked: np.ndarray, own: np.ndarray, k: np.ndarray
) -> np.ndarray:
    """For every question the ``k``-th smallest (from 0) of the values of batches before ``asked`` (with ``own``: up to it) and the ``fixed`` ones.

    The ranks are partitioned bit by bit (a wavelet matrix over the batches' order), so all questions take one step per
    bit: they go to the half that holds their value, by counts of the half inside their prefix.
    """
    order = np.argsort(batches, kind="stable")
    batches = batches[order]
    distinct, ranks = np.unique(np.concatenate((values[order], fixed)), return_inverse=True)
    ranks = ranks.ravel()
    bits = max(1, int(len(distinct) - 1).bit_length())
    weight = np.zeros((1 << bits) + 1, dtype=np.int64)
    np.add.at(weight, ranks[len(values) :] + 1, weights)
    weight = np.cumsum(weight)
    current = ranks[: len(values)]
    left = np.zeros(len(asked), dtype=np.int64)
    right = np.where(own, np.searchsorted(batches, asked, side="right"), np.searchsorted(batches, asked, side="left"))
    low, k = np.zeros(len(asked), dtype=np.int64), k.copy()
    for bit in range(bits - 1, -1, -1):
        upper = (current >> bit) & 1
        zeros = np.concatenate((np.zeros(1, np.int64), np.cumsum(1 - upper)))
        inside = zeros[right] - zeros[left] + weight[low + (1 << bit)] - weight[low]
        up = k >= inside
        k = np.where(up, k - inside, k)
        left = np.where(up, zeros[-1] + left - zeros[left], zeros[left])
        right = np.where(up, zeros[-1] + right - zeros[right], zeros[right])
        low = np.where(up, low + (1 << bit), low)
        current = np.concatenate((current[upper == 0], current[upper == 1]))
    return distinct[np.minimum(low, len(distinct) - 1)] if len(distinct) else np.full(len(asked), np.nan)


def _kth_parts(rows: DataFrame, saved: DataFrame, parts: int, queries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``queries`` with ``node``, the part of their k-th row among the earlier ones, and ``k`` inside that part."""
    shift = -(-max((parts - 1).bit_length(), 1) // BITS) * BITS
    names = [f"c{i}" for i in range(1 << BITS)]
    place = [*keys, "node"]
    while shift > 0:
        node, child = F.shiftright("part", shift), F.shiftright("part", shift - BITS).bitwiseAND((1 << BITS) - 1)

        def counted(table: DataFrame, by: Sequence[str], node=node, child=child) -> DataFrame:
            split = table.withColumn("node", node).withColumn("child", child).join(queries.select(*by[: by.index("node") + 1]).distinct(), by[: by.index("node") + 1], "left_semi")
            return split.groupBy(*by).agg(*[F.sum(F.when(F.col("child") == i, F.col("w")).otherwise(0)).alias(c) for i, c in enumerate(names)])

        cells = counted(rows, [*place, "_batch"])
        marks = queries.select(*place, "_batch").distinct().select("*", *[F.lit(0).cast("long").alias(c) for c in names])
        table = cells.unionByName(marks).groupBy(*place, "_batch").agg(*[F.sum(c).alias(c) for c in names])
        upto = _batch_totals(table, names, place)
        seen = upto.select(*place, "_batch", F.array(*names).alias("mine"), F.array(*[f"{c}_upto" for c in names]).alias("upto"))
        start = counted(saved, ["feature", "node"]).select("feature", "node", F.array(*names).alias("start"))
        asked = queries.join(seen, [*place, "_batch"]).join(start, ["feature", "node"], "left")
        counts = F.expr(
            "transform(upto, (u, i) -> u - CASE WHEN own THEN 0 ELSE mine[i] END + coalesce(start[i], 0))"
        )
        step = F.expr(
            "aggregate(counts, named_struct('child', 0L, 'left', k, 'done', false), (s, c) -> CASE WHEN s.done OR s.left < c"
            " THEN named_struct('child', s.child, 'left', s.left, 'done', true)"
            " ELSE named_struct('child', s.child + 1, 'left', s.left - c, 'done', false) END)"
        )
        queries = settle(
            asked.withColumn("counts", counts)
            .withColumn("step", step)
            .select(*keys, "_batch", "own", "q", F.col("step.left").alias("k"), (F.col("node") * (1 << BITS) + F.col("step.child")).alias("node"))
        )
        shift -= BITS
    return queries


def running_scale(df: DataFrame, features: Sequence[str], *, batch: str = "batch_id", stream: Sequence[str] = (), **options) -> DataFrame:
    """Robust scaling of each batch by the quantiles of all earlier ones; other columns pass unscaled.

    ``(x - q50) / (q84 - q16)``, 0 where that is not a finite number, limited to +-1e6.
    """
    quantiles = earlier_batches(df, features, batch=batch, stream=stream, **options)
    joined = df.join(quantiles, on=[*stream, batch])
    scaled = {
        f: clip(
            finite_or(
                F.when(
                    F.col(f"{f}_q2") != F.col(f"{f}_q0"),
                    (F.col(f) - F.col(f"{f}_q1")) / (F.col(f"{f}_q2") - F.col(f"{f}_q0")),
                ),
                0.0,
            ),
            SCALE_LIMIT,
        )
        for f in features
    }
    return joined.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def reference_scale(
    df: DataFrame, reference: DataFrame, features: Sequence[str], *, kind: str = "standard", group: Sequence[str] = ()
) -> DataFrame:
    """Scale by percentiles of a reference group: ``minmax`` (1, 99) or ``standard`` (16, 50, 84).

    Rows of a group that holds much of the data are dealt to many tasks (``heavy_join``).
    """
    probs = [0.01, 0.99] if kind == "minmax" else [0.16, 0.5, 0.84]
    low, centre, high = (0, 0, 1) if kind == "minmax" else (0, 1, 2)
    group, features = list(group), list(features)
    entries = ", ".join(f"named_struct('_f', {i}, '_v', cast({f} AS double))" for i, f in enumerate(features))
    marks = exact_quantiles(reference.selectExpr(*group, f"inline(array({entries}))"), "_v", probs, group=[*group, "_f"], out="_q", few=not group)
    # All marks of a group in one row: one join, whatever the number of features.
    row = marks.groupBy(*group).agg(*[F.max(F.when(F.col("_f") == i, F.col(f"_q{j}"))).alias(f"_m{i}_{j}") for i in range(len(features)) for j in range(len(probs))])
    rows = heavy_join(df, row, group, spread=[F.monotonically_increasing_id()]) if group else df.withColumn("_one", F.lit(0)).join(F.broadcast(row.withColumn("_one", F.lit(0))), "_one")
    scaled = {}
    for i, f in enumerate(features):
        spread = F.col(f"_m{i}_{high}") - F.col(f"_m{i}_{low}")
        scaled[f] = (F.col(f) - F.col(f"_m{i}_{centre}")) / F.when(spread == 0, 1.0).otherwise(spread)
    return rows.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def ks_statistic(df: DataFrame, features: Sequence[str], is_second: str, *, group: Sequence[str] = ()) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per group and feature with its asymptotic p-value.

    ``is_second`` is a SQL condition telling the two samples apart. Equal values collapse before the
    shuffle, and the two distribution functions come from balanced running totals.
    """
    group = list(group)
    entries = ", ".join(f"named_struct('feature', '{f}', 'v', cast({f} AS double))" for f in features)
    counts = (
        df.selectExpr(*group, f"({is_second}) AS _second", f"inline(array({entries}))")
        .where("v IS NOT NULL")
        .groupBy(*group, "feature", "v")
        .agg(F.count_if(~F.col("_second")).alias("a"), F.count_if(F.col("_second")).alias("b"))
    )
    keys = [*group, "feature"]
    totals = counts.groupBy(*keys).agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
    steps = running_totals(counts, ["a", "b"], ["v"], stream=keys).join(totals, on=keys)
    gap = F.abs(F.col("a_upto") / F.col("n") - F.col("b_upto") / F.col("m"))
    found = steps.groupBy(*keys, "n", "m").agg(F.max(gap).alias("statistic"))
    root = F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m")))
    terms = F.sequence(F.lit(1), F.lit(100))
    x = F.col("statistic") * root
    series = F.aggregate(
        terms,
        F.lit(0.0),
        lambda s, j: s + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.lit(-2.0) * j * j * x * x),
    )
    p = F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
    return found.withColumn("p_value", p)


def ks_multivariate(df: DataFrame, features: Sequence[str], is_second: str, *, group: Sequence[str] = ()) -> DataFrame:
    """Smallest p-value over the features."""
    found = ks_statistic(df, features, is_second, group=group)
    return found.groupBy(*group).agg(F.min("p_value").alias("p_value"), F.max("statistic").alias("statistic"))


def reservoir(df: DataFrame, key: Sequence[str], *, k: int = CONCEPT_MAX_ROWS, seed: int = 0, by: Sequence[str] = ("seq",)) -> DataFrame:
    """Uniform sample of ``k`` rows per key, the same on every run."""
    return sample_per_group(df, key, k, seed=seed, by=by)


def sampled_range(
    df: DataFrame, start: int, end: int, k: int, *, index: str = "seq", time: str = "t", seed: int = 0
) -> DataFrame:
    """At most ``k`` random rows with ``start <= index < end``, in time order."""
    chosen = df.where((F.col(index) >= start) & (F.col(index) < end)).orderBy(stable_rank(seed, index), index).limit(k)
    return chosen.orderBy(time)


"""Arrival numbers and micro-batches without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.schema import BATCH_ROWS
from tidewire.session import cut, settle


def row_index(
    df: DataFrame, order: Sequence[str], *, stream: Sequence[str] = (), name: str = "idx", partitions: int | None = None, stored: bool = False
) -> DataFrame:
    """Number the rows 0, 1, ... in ``order``, per ``stream`` if given.

    Rows are range partitioned by (stream, order), so equal shares go to every task whatever the skew; the
    sorted rows are checkpointed once (range bounds are sampled, so a recompute could place rows anew) and
    numbered from their position plus the row counts of the partitions before. ``stored`` keeps them as a table, which takes a fraction of a
    checkpoint's bytes, and copies the offsets (one row per task and stream) to the rows instead of dealing the rows once more.
    """
    stream = list(stream)
    keys = [F.col(c) for c in [*stream, *order]]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    rows, place = ranged.sortWithinPartitions(*keys), F.monotonically_increasing_id().alias("_place")
    placed = settle(rows.select("*", place)) if stored else cut(rows).select("*", place)
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    counts = placed.groupBy(*stream, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_from"))
    # One row per partition and stream.
    before = Window.partitionBy(*stream).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *stream, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_shift")
    )
    return placed.join(F.broadcast(offsets) if stored else offsets, on=[*stream, "_part"]).select(
        *df.columns, (F.col("_place") + F.col("_shift")).alias(name)
    )


def arrival(
    df: DataFrame, stream: Sequence[str] = (), *, order: Sequence[str] = ("t", "seq"), name: str = "_arrival", stored: bool = False
) -> DataFrame:
    """Number the rows of each stream in time order; a table that is numbered already stays as it is.

    Sources may deliver late, and their own numbers may jump (byte offsets) or repeat (one capture's number in
    another one), so order and identity of rows rest on this number only.
    """
    return df if name in df.columns else row_index(df, order, stream=stream, name=name, stored=stored)


def batches(df: DataFrame, index: str = "idx", rows: int = BATCH_ROWS, name: str = "batch_id") -> DataFrame:
    """Fixed-size micro-batches from an arrival number."""
    return df.withColumn(name, F.floor(F.col(index) / F.lit(rows)))


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of a stream (a record limit of the source)."""
    return df.orderBy(*order).limit(n)


def first_seen_ids(df: DataFrame, node: str, seq: str = "seq", name: str = "node_id") -> DataFrame:
    """Dense numbers of the nodes in the order they first appear."""
    first = df.groupBy(node).agg(F.min(seq).alias("first_seq"))
    return row_index(first, ["first_seq", node], name=name)


def running_totals(
    df: DataFrame, columns: Sequence[str], order: Sequence, *, stream: Sequence[str] = (), suffix: str = "_upto"
) -> DataFrame:
    """Running sums (including the row) per stream in ``order``, balanced over tasks whatever the skew.

    ``order`` must be unique within a stream: rows are range partitioned, summed inside each partition and
    shifted by the totals of the partitions before. ``order`` may hold columns such as ``F.desc('x')``.
    """
    stream = list(stream)
    keys = [*stream, *order]
    placed = cut(df.repartitionByRange(*keys)).withColumn("_part", F.spark_partition_id())
    totals = placed.groupBy(*stream, "_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    before = Window.partitionBy(*stream).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        *stream, "_part", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns]
    )
    inside = Window.partitionBy(*stream, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", *[F.sum(c).over(inside).alias(f"_s_{c}") for c in columns])
    return summed.join(shifts, on=[*stream, "_part"]).select(
        *df.columns, *[(F.col(f"_s_{c}") + F.col(f"_b_{c}")).alias(f"{c}{suffix}") for c in columns]
    )


def heavy_join(left: DataFrame, right: DataFrame, on: Sequence[str], *, spread: Sequence, counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has at most one row per key, where a few keys may hold most left rows.

    Keys are counted first (before the shuffle). Those with more than HEAVY rows and more than a quarter of an even share of the left
    rows, at most four per shuffle partition, are heavy: their left rows are dealt by a hash of ``spread`` and their right row is
    copied to every share; without any the join stays as it is. ``left`` is read twice, so it should be stored, unless ``counts``
    (on, _n) already tells how many left rows the keys have; ``total`` is the number of left rows, if known. Rows are sorted and
    merged also where the right side is small: loops join many times, and every broadcast would take pages of the driver's memory.
    """
    on = list(on)
    right = right.hint("merge")
    shares = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = left.groupBy(*on).agg(F.count("*").alias("_n")) if counts is None else counts.select(*on, "_n")
    every = counts.agg(F.sum("_n").alias("_all")).scalar() if total is None else F.lit(total)
    heavy = counts.where((F.col("_n") > HEAVY) & (F.col("_n") * (4 * shares) > every)).select(F.xxhash64(*on)).collect()  # at most 4 * shares
    if not heavy:
        return left.join(right, on)
    is_heavy = F.xxhash64(*on).isin([r[0] for r in heavy])
    mine = left.withColumn("_share", F.when(is_heavy, F.pmod(F.xxhash64(*spread), F.lit(shares)).cast("int")).otherwise(F.lit(0)))
    every_share = F.when(is_heavy, F.sequence(F.lit(0), F.lit(shares - 1))).otherwise(F.array(F.lit(0)))
    return mine.join(right.withColumn("_share", F.explode(every_share)).hint("merge"), [*on, "_share"]).drop("_share")


HEAVY = 1_000  # rows of a key that are no burden to one task

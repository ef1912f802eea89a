"""An evolving graph as a change log: upserts (``type`` 1) and link deletions (``type`` 0).

Changes have ``batch_id, seq, type, src, dst`` and, on upserts, ``src_*``, ``dst_*`` node features and edge
features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def live_edges(changes: DataFrame, features: Sequence[str], *, as_of: int | None = None, stream: Sequence[str] = ()) -> DataFrame:
    """Edges alive after batch ``as_of`` with their latest features."""
    log = changes if as_of is None else changes.where(F.col("batch_id") <= as_of)
    order = F.struct("batch_id", "seq", "type")
    latest = log.groupBy(*stream, "src", "dst").agg(F.max_by(F.struct("type", *features), order).alias("e"))
    return latest.where("e.type = 1").select(*stream, "src", "dst", *[f"e.{f}" for f in features])


def live_nodes(
    changes: DataFrame,
    src_features: Sequence[str],
    dst_features: Sequence[str],
    names: Sequence[str],
    *,
    as_of: int | None = None,
    stream: Sequence[str] = (),
) -> DataFrame:
    """Nodes that still have an edge after batch ``as_of``, with the features of their latest row.

    Within one row the destination role counts as the later one.
    """
    log = changes if as_of is None else changes.where(F.col("batch_id") <= as_of)
    order = F.struct("batch_id", "seq", "role")
    roles = log.where("type = 1").select(
        *stream,
        "batch_id",
        "seq",
        F.explode(
            F.array(
                F.struct(
                    F.col("src").alias("node"),
                    F.lit(0).alias("role"),
                    *[F.col(c).alias(n) for c, n in zip(src_features, names, strict=True)],
                ),
                F.struct(
                    F.col("dst").alias("node"),
                    F.lit(1).alias("role"),
                    *[F.col(c).alias(n) for c, n in zip(dst_features, names, strict=True)],
                ),
            )
        ).alias("r"),
    ).select(*stream, "batch_id", "seq", "r.*")
    latest = roles.groupBy(*stream, "node").agg(F.max_by(F.struct(*names), order).alias("f"))
    ends = (
        live_edges(changes, [], as_of=as_of, stream=stream)
        .select(*stream, F.explode(F.array("src", "dst")).alias("node"))
        .distinct()
    )
    return latest.join(ends, on=[*stream, "node"], how="left_semi").select(
        *stream, "node", *[f"f.{n}" for n in names]
    )


def edge_versions(
    changes: DataFrame, features: Sequence[str], *, keep: str = "last", stream: Sequence[str] = (), block: int = 65_536
) -> DataFrame:
    """The live graph of every batch at once: one row per edge state with its range of batches.

    A version is valid from ``from_batch`` up to, not including, ``to_batch`` (null: still valid). Inside a
    batch the last change of an edge decides; ``keep='first'`` takes the features of its first upsert
    instead. The per-batch reduction runs first; the next change of an edge is then looked up inside blocks of
    ``block`` batches, and across blocks in a table of one row per edge and block.
    """
    key = [*stream, "src", "dst"]
    order = F.struct("seq", "type")
    picked = F.max_by(F.struct(*features), order) if keep == "last" else F.min_by(
        F.struct(*features), F.when(F.col("type") == 1, order)
    )
    per_batch = changes.groupBy(*key, "batch_id").agg(
        F.max_by("type", order).alias("type"), picked.alias("f")
    )
    blocked = per_batch.withColumn("_block", F.floor(F.col("batch_id") / F.lit(block)))
    inside = Window.partitionBy(*key, "_block").orderBy("batch_id")
    across = (
        blocked.groupBy(*key, "_block")
        .agg(F.min("batch_id").alias("_first"))
        .withColumn("_later", F.lead("_first").over(Window.partitionBy(*key).orderBy("_block")))
    )
    return (
        blocked.withColumn("_near", F.lead("batch_id").over(inside))
        .join(across, on=[*key, "_block"])
        .where("type = 1")
        .select(
            *key,
            F.col("batch_id").alias("from_batch"),
            F.coalesce("_near", "_later").alias("to_batch"),
            *[f"f.{f}" for f in features],
        )
    )

"""Shards of near equal bytes by a k-d tree over document metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.text import content_key
from tidewire.operators.index import row_index, running_totals
from tidewire.session import settle

SHARDS = 16
# A group of equal texts above this share of all bytes is divided; so there are at most this many of them.
HEAVY = 64
DIMENSIONS = ("d_length", "d_id", "d_source", "d_lang")


def shard(docs: DataFrame, *, shards: int = SHARDS) -> DataFrame:
    """Shards 0 to ``shards`` - 1 of near equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The points are groups of equal texts (null counts as empty), so copies share a shard; a group above a
    64th of all bytes is dealt by doc_id into pieces of about that weight. A node of the tree is split at
    the weighted median along the dimension (log length, smallest doc_id, source, language) in which it
    is widest relative to the whole table, until ``shards`` leaves of the target bytes are left. Ties on a coordinate
    are broken by the group, so the halves differ by one piece at most. Only the widths of the at most
    ``shards`` nodes reach the driver; the medians come from distributed running totals. Null metadata
    counts as zero; repeated rows are rows of their own; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = settle(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            content_key("text").alias("_group"),
            F.crc32(F.coalesce(F.col("source").cast("string"), F.lit("")).cast("binary")).alias("_source"),
            F.crc32(F.coalesce(F.col("lang").cast("string"), F.lit("")).cast("binary")).alias("_lang"),
        )
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    weights = rows.groupBy("_group").agg(F.sum("size").alias("_bytes"))
    # At most HEAVY rows, since each holds more than that share of the bytes.
    heavy = weights.where(F.col("_bytes") * HEAVY > total).select("_group", F.ceil(F.col("_bytes") * HEAVY / F.lit(max(total, 1))).cast("int").alias("_pieces"))
    piece = F.when(F.col("_pieces") > 1, F.pmod(F.xxhash64("doc_id"), F.col("_pieces"))).otherwise(0).cast("int")
    rows = rows.join(F.broadcast(heavy), "_group", "left").withColumn("_piece", piece).drop("_pieces")
    points = rows.groupBy("_group", "_piece").agg(
        F.sum("size").alias("w"),
        F.log2(F.max("size").cast("double")).alias("d_length"),
        F.coalesce(F.min("doc_id"), F.lit(0)).cast("double").alias("d_id"),
        F.min("_source").cast("double").alias("d_source"),
        F.min("_lang").cast("double").alias("d_lang"),
    ).withColumn("node", F.lit(0))
    placed = settle(points)
    leaves = {0: shards}
    first = {0: 0}
    while any(n > 1 for n in leaves.values()):
        placed, leaves, first = _split(placed, leaves, first)
    owner = F.create_map(*[F.lit(x) for node in leaves for x in (node, first[node])])
    found = rows.join(placed.select("_group", "_piece", owner[F.col("node")].alias("shard")), ["_group", "_piece"])
    slots = row_index(found.select("doc_id", "size", "text_crc32", "shard"), ["doc_id", "text_crc32", "size"], stream=["shard"], name="slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _split(placed: DataFrame, leaves: dict[int, int], first: dict[int, int]):
    """Split every node that stands for more than one leaf at its weighted median."""
    widths = {
        r["node"]: r
        for r in placed.groupBy("node")
        .agg(F.sum("w").alias("w"), *[F.max(d).alias(f"max_{d}") for d in DIMENSIONS], *[F.min(d).alias(f"min_{d}") for d in DIMENSIONS])
        .collect()  # one row per node, at most the number of shards
    }
    whole = {d: (max((r[f"max_{d}"] for r in widths.values()), default=0.0) - min((r[f"min_{d}"] for r in widths.values()), default=0.0)) or 1.0 for d in DIMENSIONS}
    coordinate, goal = F.lit(0.0), F.lit(0.0)
    next_leaves, next_first = {}, {}
    for node, n in leaves.items():
        r = widths.get(node)
        left = n // 2
        if n > 1:
            next_leaves |= {2 * node + 1: left, 2 * node + 2: n - left}
            next_first |= {2 * node + 1: first[node], 2 * node + 2: first[node] + left}
        else:
            next_leaves[node], next_first[node] = n, first[node]
        if r is not None and n > 1:
            widest = max(DIMENSIONS, key=lambda d: (r[f"max_{d}"] - r[f"min_{d}"]) / whole[d])
            coordinate = F.when(F.col("node") == node, F.col(widest)).otherwise(coordinate)
            goal = F.when(F.col("node") == node, F.lit(float(r["w"] * left / n))).otherwise(goal)
    inner = reduce(lambda a, node: a | (F.col("node") == node), [node for node, n in leaves.items() if n > 1], F.lit(False))
    summed = running_totals(placed.withColumn("_at", coordinate), ["w"], ["_at", "_group", "_piece"], stream=["node"])
    # A point goes left if its middle lies left of the goal.
    child = 2 * F.col("node") + F.when(F.col("w_upto") - F.col("w") / 2 <= goal, 1).otherwise(2)
    moved = summed.withColumn("node", F.when(inner, child).otherwise(F.col("node")).cast("int")).drop("_at", "w_upto")
    return settle(moved), next_leaves, next_first

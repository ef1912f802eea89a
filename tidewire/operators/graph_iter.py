"""Iterative graph measures: components and shortest paths of all snapshots at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.graph import SNAP
from tidewire.operators.index import heavy_join, row_index
from tidewire.session import settle


FIXED = 8  # rounds of a contraction that share an order


def _named(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(snapshot, node, id) of the distinct nodes, with ``hashed`` ids."""
    return hashed(nodes.select(SNAP, "node").where(F.col(SNAP).isNotNull() & F.col("node").isNotNull()).distinct())


def hashed(names: DataFrame) -> tuple[DataFrame, int]:
    """``names`` with ``id``, a 64-bit hash of ``node`` that is unique inside its snapshot, and the seed that made it so."""
    seed = 0
    while True:
        named = settle(names.withColumn("id", F.xxhash64(F.lit(seed), "node")))
        if named.groupBy(SNAP, "id").agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
            return named, seed
        seed += 1


def _turned(column: Column, by: int) -> Column:
    """The bits of a long, rotated to the left."""
    return F.shiftleft(column, by % 64).bitwiseOR(F.shiftrightunsigned(column, -by % 64))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(snapshot, node, root): the nodes of one component, and only they, share a root (a long) in their snapshot.

    Randomised contraction: a round maps every node to the one of itself and its neighbours that comes first in an order of hashed
    ids, and the edges to those between the images. The rounds shrink and end without edges; their maps are joined from the last one
    back. The first rounds share an order, in which a graph of small diameter ends after as many; later ones have an
    order each, in which about half of the nodes that still have an edge go, whatever the shape.
    Only edges between ``nodes`` count. Nothing is broadcast, so the rounds take no memory of the driver.
    """
    named, seed = _named(nodes)
    left = edges.where("src <> dst").select(SNAP, F.xxhash64(F.lit(seed), "src").alias("a"), F.xxhash64(F.lit(seed), "dst").alias("b"))
    left = left.select(SNAP, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for end in "ab":
        left = left.join(named.select(SNAP, F.col("id").alias(end)).hint("merge"), [SNAP, end], "left_semi")
    left, maps = settle(left), []
    while not left.isEmpty():
        by = 13 * max(0, len(maps) - FIXED)  # from then on other bits of the ids lead in each round
        ends = [F.struct(F.col(one).alias("id"), _turned(F.col(other), by).alias("other")) for one, other in ("ab", "ba")]
        near = left.select(SNAP, F.inline(F.array(*ends))).groupBy(SNAP, "id").agg(F.min("other").alias("other"))
        step = settle(near.select(SNAP, "id", _turned(F.least("other", _turned(F.col("id"), by)), -by).alias("root")))
        maps.append(step)
        for end in "ab":
            image = step.select(SNAP, F.col("id").alias(end), F.col("root").alias("_to")).hint("merge")
            left = left.join(image, [SNAP, end]).withColumn(end, F.col("_to")).drop("_to")
        left = settle(left.where("a <> b").select(SNAP, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = maps.pop() if maps else None
    for step in reversed(maps):
        after = found.select(SNAP, F.col("id").alias("root"), F.col("root").alias("_next")).hint("merge")
        found = settle(step.join(after, [SNAP, "root"], "left").select(SNAP, "id", F.coalesce("_next", "root").alias("root")))
    if found is None:
        return named.select(SNAP, "node", F.col("id").alias("root"))
    return settle(named.join(found.hint("merge"), [SNAP, "id"], "left").select(SNAP, "node", F.coalesce("root", "id").alias("root")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected component of each node (``roots``): the smallest node name in it. A root that most nodes share is no heavy key."""
    rooted = roots(nodes, edges)
    names = settle(rooted.groupBy(SNAP, "root").agg(F.min("node").alias("label"), F.count("*").alias("_n")))
    return settle(heavy_join(rooted, names.drop("_n"), [SNAP, "root"], spread=["node"], counts=names).select(SNAP, "node", "label"))


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of the largest component per snapshot (ties: the smallest label) with their count."""
    labels = components(nodes, edges)
    sizes = labels.groupBy(SNAP, "label").agg(F.count("*").alias("size"))
    best = sizes.groupBy(SNAP).agg(
        F.sum("size").alias("num_nodes"),
        F.max("size").alias("lcc_size"),
    )
    pick = (
        sizes.join(best, on=SNAP)
        .where("size = lcc_size")
        .groupBy(SNAP, "num_nodes", "lcc_size")
        .agg(F.min("label").alias("label"))
    )
    return labels.join(pick, on=[SNAP, "label"]).select(SNAP, "node", "num_nodes", "lcc_size")


def lcc_ratio(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of the nodes in the largest component."""
    sizes = roots(nodes, edges).groupBy(SNAP, "root").agg(F.count("*").alias("size"))
    return sizes.groupBy(SNAP).agg((F.max("size") / F.sum("size")).alias("lcc_ratio"))


def path_measures(nodes: DataFrame, edges: DataFrame, *, words: int = 4, blocks_at_once: int = 256) -> DataFrame:
    """Mean shortest path length and diameter of the largest component, exact.

    Breadth-first search from all sources: a node carries one bit per source in blocks of ``64 * words`` sources, a step
    moves the bits along the edges (``bit_or`` per node and block, combined before the shuffle), and the number of bits
    that arrive is the number of pairs at that distance. No list of node pairs is ever made. Up to ``blocks_at_once`` blocks of
    every snapshot advance together, so the rounds are the distances.
    """
    lcc = row_index(largest_component(nodes, edges), ["node"], stream=[SNAP], name="no")
    lcc = settle(lcc)
    ids = lcc.select(SNAP, "node")
    both = edges.where("src <> dst").select(
        SNAP,
        F.explode(
            F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
        ).alias("e"),
    ).select(SNAP, "e.src", "e.dst").distinct()
    both = settle(both.join(ids.withColumnRenamed("node", "src"), on=[SNAP, "src"], how="left_semi"))
    per_block = 64 * words
    blocks = (lcc.agg(F.max("no")).first()[0] or 0) // per_block + 1
    any_bit = " OR ".join(f"f{w} <> 0" for w in range(words))
    arrived = " + ".join(f"bit_count(f{w})" for w in range(words))
    found = []
    for start in range(0, blocks, blocks_at_once):
        at = f"(no - {per_block} * block)"
        bits = [
            f"CASE WHEN {at} >= {64 * w} AND {at} < {64 * (w + 1)} THEN shiftleft(1L, cast({at} - {64 * w} AS int)) ELSE 0L END"
            for w in range(words)
        ]
        # A row per node and block of its snapshot's sources.
        last = f"least(cast((lcc_size - 1) DIV {per_block} AS int), {min(blocks, start + blocks_at_once) - 1})"
        dealt = lcc.where(f"lcc_size > {start * per_block}").selectExpr(SNAP, "node", "no", f"explode(sequence({start}, {last})) AS block")
        front = settle(dealt.selectExpr(SNAP, "node", "block", *[f"{b} AS f{w}" for w, b in enumerate(bits)]).where(any_bit))
        seen = front.selectExpr(SNAP, "node", "block", *[f"f{w} AS s{w}" for w in range(words)])
        distance = 0
        while True:
            distance += 1
            moved = (
                both.join(front.withColumnRenamed("node", "src"), on=[SNAP, "src"])
                .groupBy(SNAP, F.col("dst").alias("node"), "block")
                .agg(*[F.bit_or(f"f{w}").alias(f"m{w}") for w in range(words)])
            )
            state = settle(
                seen.join(moved, on=[SNAP, "node", "block"], how="full").selectExpr(
                    SNAP, "node", "block",
                    *[f"coalesce(s{w}, 0L) | coalesce(m{w}, 0L) AS s{w}" for w in range(words)],
                    *[f"coalesce(m{w}, 0L) & ~coalesce(s{w}, 0L) AS f{w}" for w in range(words)],
                )
            )
            front = state.where(any_bit).select(SNAP, "node", "block", *[f"f{w}" for w in range(words)])
            seen = state.select(SNAP, "node", "block", *[f"s{w}" for w in range(words)])
            step = settle(front.groupBy(SNAP).agg(F.expr(f"sum({arrived})").alias("pairs")))
            if step.isEmpty():
                break
            found.append(step.select(SNAP, F.lit(distance).alias("distance"), "pairs"))
    sizes = lcc.select(SNAP, "lcc_size").distinct()
    if not found:
        return sizes.select(SNAP, F.lit(0.0).alias("avg_shortest_path_length_lcc"), F.lit(0).alias("diameter_lcc"))
    reached = (
        reduce(DataFrame.unionByName, found)
        .groupBy(SNAP)
        .agg(F.sum(F.col("distance") * F.col("pairs")).alias("_total"), F.max("distance").alias("_far"))
    )
    n = F.col("lcc_size")
    return sizes.join(reached, on=SNAP, how="left").select(
        SNAP,
        F.coalesce(F.col("_total") / (n * (n - 1)), F.lit(0.0)).alias("avg_shortest_path_length_lcc"),
        F.coalesce("_far", F.lit(0)).alias("diameter_lcc"),
    )

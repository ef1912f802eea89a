"""Graph snapshots: construction, set operations, statistics and linear message passing.

A graph is two tables: ``nodes(snapshot_id, node, ...)`` and ``edges(snapshot_id, src, dst, ...)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.columns import stable_rank
from tidewire.operators.index import row_index
from tidewire.session import settle

SNAP = "snapshot_id"

_ENDPOINTS = {
    "physical": ("src_mac", "dst_mac"),
    "internet": ("src_ip", "dst_ip"),
    "transport": ("concat_ws(':', src_ip, src_port)", "concat_ws(':', dst_ip, dst_port)"),
}


def layer_nodes(packets: DataFrame, layer: str = "physical") -> DataFrame:
    """Nodes of a one-layer graph: packets and bytes received minus sent."""
    src, dst = _ENDPOINTS[layer]
    ends = packets.selectExpr(
        SNAP,
        f"explode(array(named_struct('node', {src}, 'sign', -1), named_struct('node', {dst}, 'sign', 1))) AS e",
        "packet_size",
    )
    return ends.groupBy(SNAP, F.col("e.node").alias("node")).agg(
        F.sum("e.sign").alias("count"), F.sum(F.col("e.sign") * F.col("packet_size")).alias("size")
    )


def layer_edges(packets: DataFrame, layer: str = "physical") -> DataFrame:
    """Distinct directed edges of a one-layer graph."""
    src, dst = _ENDPOINTS[layer]
    return packets.selectExpr(SNAP, f"{src} AS src", f"{dst} AS dst").distinct()


def multilayer_edges(packets: DataFrame) -> DataFrame:
    """Edges of the three-layer graph with summed size and count.

    Up to seven edges per packet: one inside each layer and four between layers. Payload lengths are taken
    from ``ether_payload``, ``ip_payload``, ``transport_payload`` where present, else the packet size for the
    first two and 0 for the transport layer.
    """
    have = set(packets.columns)
    ether = "ether_payload" if "ether_payload" in have else "packet_size"
    ip = "ip_payload" if "ip_payload" in have else "packet_size"
    transport = "transport_payload" if "transport_payload" in have else "0"
    src_sock, dst_sock = _ENDPOINTS["transport"]
    always = [
        ("src_mac", "dst_mac", ether),
        ("src_ip", "dst_ip", ip),
        ("src_ip", "src_mac", ip),
        ("dst_mac", "dst_ip", ether),
    ]
    ported = [(src_sock, dst_sock, transport), (src_sock, "src_ip", transport), ("dst_ip", dst_sock, ip)]

    def structs(kinds) -> str:
        return ", ".join(
            f"named_struct('src', {a}, 'dst', {b}, 'size', cast({size} AS double))" for a, b, size in kinds
        )

    exploded = packets.selectExpr(
        SNAP,
        "explode(CASE WHEN src_port <> '' AND dst_port <> ''"
        f" THEN array({structs(always + ported)}) ELSE array({structs(always)}) END) AS e",
    )
    return exploded.groupBy(SNAP, F.col("e.src").alias("src"), F.col("e.dst").alias("dst")).agg(
        F.sum("e.size").alias("size"), F.count("*").alias("count")
    )


def multilayer_nodes(packets: DataFrame) -> DataFrame:
    """Nodes of the three-layer graph with their layer."""
    src_sock, dst_sock = _ENDPOINTS["transport"]
    base = [("src_mac", "Physical"), ("dst_mac", "Physical"), ("src_ip", "Internet"), ("dst_ip", "Internet")]
    sockets = [(src_sock, "Transport"), (dst_sock, "Transport")]

    def structs(kinds) -> str:
        return ", ".join(f"named_struct('node', {node}, 'layer', '{layer}')" for node, layer in kinds)

    return packets.selectExpr(
        SNAP,
        "explode(CASE WHEN src_port <> '' AND dst_port <> ''"
        f" THEN array({structs(base + sockets)}) ELSE array({structs(base)}) END) AS e",
    ).select(SNAP, "e.node", "e.layer").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Attribute-free copy: distinct unordered edges."""
    return edges.select(
        SNAP, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    ).distinct()


def plain(df: DataFrame) -> DataFrame:
    return df


def drop_silent_nodes(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove nodes whose count and size are both 0, and their edges."""
    kept = nodes.where("NOT (count = 0 AND size = 0)")
    return kept, edges_among(edges, kept)


def edges_among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are in ``nodes``."""
    ids = nodes.select(SNAP, "node")
    for end in ("src", "dst"):
        edges = edges.join(ids.withColumnRenamed("node", end), on=[SNAP, end], how="left_semi")
    return edges


def edge_positions(edges: DataFrame, searched: DataFrame, *, position: str = "position") -> DataFrame:
    """Position of each searched edge in ``edges`` (-1 if absent) and whether it exists."""
    keys = [c for c in (SNAP, "src", "dst") if c in searched.columns]
    found = searched.join(edges.select(*keys, position), on=keys, how="left")
    return found.withColumn("exists", F.col(position).isNotNull()).withColumn(
        position, F.coalesce(position, F.lit(-1).cast("long"))
    )


def complete_pair_count(nodes: DataFrame) -> DataFrame:
    """Number of ordered pairs of different nodes per snapshot (the pairs themselves are never listed)."""
    return nodes.groupBy(SNAP).agg(F.count("*").alias("nodes")).withColumn(
        "pairs", F.col("nodes") * (F.col("nodes") - 1)
    )


def degree_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Size, density and degree statistics per snapshot of an undirected graph."""
    ends = edges.select(SNAP, F.explode(F.array("src", "dst")).alias("node"), F.lit(1).alias("one"))
    degree = (
        nodes.select(SNAP, "node", F.lit(0).alias("one")).unionByName(ends).groupBy(SNAP, "node").agg(F.sum("one").alias("d"))
    )
    n, e = F.col("num_nodes"), F.col("num_edges")
    return (
        degree.groupBy(SNAP)
        .agg(
            F.count("*").alias("num_nodes"),
            (F.sum("d") / 2).cast("long").alias("num_edges"),
            F.var_pop("d").alias("degree_variance"),
            F.max("d").alias("max_degree"),
        )
        .withColumn("edge_density", F.when(n <= 1, 0.0).otherwise(2 * e / (n * (n - 1))))
        .withColumn("mean_degree", 2 * e / n)
    )


def consecutive_jaccard(edges: DataFrame) -> DataFrame:
    """Share of common edges between each snapshot and the next.

    Every edge votes in the comparison its snapshot opens and in the one it closes, so one grouping on the
    edge replaces the join of the two edge sets.
    """
    votes = edges.select(SNAP, "src", "dst").distinct().select(
        F.explode(
            F.array(
                F.struct(F.col(SNAP).alias("pair"), F.lit(1).alias("a"), F.lit(0).alias("b")),
                F.struct((F.col(SNAP) - 1).alias("pair"), F.lit(0).alias("a"), F.lit(1).alias("b")),
            )
        ).alias("v"),
        "src",
        "dst",
    )
    per_edge = votes.groupBy("v.pair", "src", "dst").agg(F.max("v.a").alias("a"), F.max("v.b").alias("b"))
    return (
        per_edge.groupBy("pair")
        .agg(
            F.sum(F.col("a") * F.col("b")).alias("shared"),
            F.count("*").alias("total"),
            F.max("a").alias("_a"),
            F.max("b").alias("_b"),
        )
        .where("_a = 1 AND _b = 1")
        .select(F.col("pair").alias(SNAP), "shared", "total", (F.col("shared") / F.col("total")).alias("iou"))
    )


def propagate(
    nodes: DataFrame, edges: DataFrame, features: Sequence[str], *, hops: int = 1, kind: str = "gcn", degree: str | None = None
) -> DataFrame:
    """Linear neighbourhood aggregation over distinct directed edges, ``hops`` times.

    gcn: ``sum_j x_j / sqrt(d_i d_j)`` over in-neighbours and the node itself, ``d`` = in-degree + 1.
    gin: the node's own features plus the sum over its in-neighbours.
    Edges and every hop's nodes are stored, since each is read more than once. ``degree`` names a column of ``nodes`` that holds the
    in-degrees already; then ``edges`` must be distinct and stored.
    """
    links = edges.select(SNAP, "src", "dst") if degree else settle(edges.select(SNAP, "src", "dst").distinct())
    weight = "_w"
    if kind == "gcn":
        if not degree:
            known, degree = links.groupBy(SNAP, F.col("dst").alias("node")).agg(F.count("*").alias("_d")), "_d"
            nodes = nodes.join(known, on=[SNAP, "node"], how="left")
        current = nodes.select(SNAP, "node", *features, (1.0 / F.sqrt(F.coalesce(degree, F.lit(0)) + 1)).alias(weight))
    else:
        current = nodes.select(SNAP, "node", *features, F.lit(1.0).alias(weight))
    for _ in range(hops):
        current = settle(current)
        scaled = current.select(SNAP, "node", weight, *[(F.col(f) * F.col(weight)).alias(f) for f in features])
        sent = links.join(scaled.withColumnRenamed("node", "src"), on=[SNAP, "src"]).select(
            SNAP, F.col("dst").alias("node"), *features, F.lit(None).cast("double").alias(weight)
        )
        own = scaled.select(SNAP, "node", *features, weight)
        current = (
            sent.unionByName(own)
            .groupBy(SNAP, "node")
            .agg(F.max(weight).alias(weight), *[F.sum(f).alias(f) for f in features])
            .where(F.col(weight).isNotNull())
            .select(SNAP, "node", *[(F.col(f) * F.col(weight)).alias(f) for f in features], weight)
        )
    return current.drop(weight)


def read_out(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """Snapshot vectors: sum and mean of the node features."""
    return nodes.groupBy(SNAP).agg(
        *[F.sum(f).alias(f"{f}_add") for f in features], *[F.avg(f).alias(f"{f}_mean") for f in features]
    )


def edge_scores(edges: DataFrame, embeddings: DataFrame, *, vector: str = "embedding") -> DataFrame:
    """Inner product of the two ends' vectors for every edge (``embeddings(node, vector)``)."""
    ends = edges
    for end, name in (("src", "_a"), ("dst", "_b")):
        ends = ends.join(embeddings.select(F.col("node").alias(end), F.col(vector).alias(name)), on=end)
    dot = F.aggregate(
        F.zip_with("_a", "_b", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x
    )
    return ends.withColumn("edge_score", dot).drop("_a", "_b")


def reconstruction_loss(scored: DataFrame, *, exists: bool = True) -> DataFrame:
    """Mean cross entropy of the edge scores per snapshot, with label 1 for existing edges."""
    sign = -1.0 if exists else 1.0
    return scored.groupBy(SNAP).agg(F.avg(F.log1p(F.exp(F.col("edge_score") * sign))).alias("loss"))


def numbered_nodes(nodes: DataFrame) -> DataFrame:
    """Dense node numbers per snapshot."""
    return row_index(nodes.select(SNAP, "node").distinct(), ["node"], stream=[SNAP], name="node_no")


WALK_BLOCK = 4_096  # places of a walk that are listed as one array
WALK_TASK = 1 << 18  # places of a walk that a task lists


def _walk(pairs: DataFrame, seed: int, rounds: int, *, back: bool = False) -> DataFrame:
    """The seeded permutation of a snapshot's pairs (``_i`` of ``_n`` numbers, ``_j`` of ``_n - 1``), or the way back.

    A step uses the one before it twice, so a filter that is pushed below all steps doubles its text with each. The ``coalesce`` spares
    a join with the result its filters on nulls; whatever else filters the result must store it first.
    """
    steps = [(k, end) for k in range(rounds) for end in ("_i", "_j")]
    for k, end in reversed(steps) if back else steps:
        other, size = ("_j", "_n") if end == "_i" else ("_i", "(_n - 1)")
        moved = f"{end} {'-' if back else '+'} pmod(xxhash64({seed}, {k}, {SNAP}, {other}), {size})"
        pairs = pairs.withColumn(end, F.expr(f"coalesce(pmod({moved}, {size}), 0L)"))
    return pairs


def negative_pairs(sizes: DataFrame, taken: DataFrame, *, seed: int = 0, rounds: int = 6) -> DataFrame:
    """(snapshot, _i, _j): node numbers of as many random non-edges per snapshot as it has edges, or of all where there are fewer.

    ``sizes`` (snapshot, _n, _all, _own) counts nodes, edges and edges that are no loops; ``taken`` (snapshot, _i, _j) holds the node
    numbers of the distinct edges. A seeded permutation walks through the numbers of a snapshot's possible pairs without repeating one,
    and the first ``goal`` non-edges on the walk are taken. The way back through the permutation tells at which places
    the edges stand, so the places to leave out are known before the walk, which is listed in blocks and only as far as it is used.
    The few bytes of the blocks pass for those of the pairs, so joins with the result need a ``merge`` hint: they would broadcast it.
    """
    goals = sizes.where("_n > 1").selectExpr(SNAP, "_n", "least(_all, _n * (_n - 1) - _own) AS _goal", "_own")
    goals = settle(goals)
    # The first end's number is skipped by the second one.
    apart = taken.where("_i <> _j").withColumn("_j", F.expr("_j - CASE WHEN _j > _i THEN 1 ELSE 0 END"))
    places = _walk(apart.join(goals, on=SNAP), seed, rounds, back=True).selectExpr(SNAP, "_goal", "_own", "_i * (_n - 1) + _j AS _at")
    met = settle(settle(places).where("_at < _goal + _own").select(SNAP, "_at", "_goal"))
    # ``_at - _k`` non-edges come before the edge at ``_at``.
    met = settle(row_index(met, ["_at"], stream=[SNAP], name="_k").where("_at - _k < _goal").select(SNAP, "_at"))
    until = goals.join(met.groupBy(SNAP).agg(F.count("*").alias("_met")), on=SNAP, how="left")
    until = settle(until.selectExpr(SNAP, "_n", "_goal + coalesce(_met, 0) AS _end").where("_end > 0"))
    tasks = -(-(until.agg(F.sum("_end")).first()[0] or 0) // WALK_TASK)
    # Named here, the number of tasks is not merged by the few bytes of the blocks.
    blocks = until.selectExpr("*", f"explode(sequence(0L, (_end - 1) div {WALK_BLOCK})) AS _block")
    edges_in = met.groupBy(SNAP, F.expr(f"_at div {WALK_BLOCK}").alias("_block")).agg(F.collect_list("_at").alias("_met"))
    dealt = blocks.join(edges_in, on=[SNAP, "_block"], how="left").repartition(max(tasks, 1), SNAP, "_block")
    every = f"sequence(_block * {WALK_BLOCK}, least((_block + 1) * {WALK_BLOCK}, _end) - 1)"
    free = dealt.selectExpr(SNAP, "_n", f"explode(CASE WHEN _met IS NULL THEN {every} ELSE array_except({every}, _met) END) AS _at")
    walk = _walk(free.selectExpr(SNAP, "_n", "_at div (_n - 1) AS _i", "_at % (_n - 1) AS _j"), seed, rounds)
    return walk.selectExpr(SNAP, "_i", "_j + CASE WHEN _j >= _i THEN 1 ELSE 0 END AS _j")


def edge_counts(edges: DataFrame) -> DataFrame:
    """Distinct edges per snapshot (``_all``), and those of them that are no loops (``_own``)."""
    return edges.groupBy(SNAP).agg(F.count("*").alias("_all"), F.count_if(F.col("src") != F.col("dst")).alias("_own"))


def negative_edges(nodes: DataFrame, edges: DataFrame, *, seed: int = 0, rounds: int = 6) -> DataFrame:
    """As many random non-edges per snapshot as it has edges, or all of them where there are fewer (``negative_pairs``)."""
    numbers, distinct = settle(numbered_nodes(nodes)), settle(edges.select(SNAP, "src", "dst").distinct())
    ends = [numbers.select(SNAP, F.col("node").alias(end), F.col("node_no").alias(no)) for end, no in (("src", "_i"), ("dst", "_j"))]
    taken = distinct.join(ends[0], on=[SNAP, "src"]).join(ends[1], on=[SNAP, "dst"]).select(SNAP, "_i", "_j")
    sizes = numbers.groupBy(SNAP).agg(F.count("*").alias("_n")).join(edge_counts(distinct), on=SNAP)
    drawn = negative_pairs(sizes, taken, seed=seed, rounds=rounds)
    return drawn.join(ends[0].hint("merge"), on=[SNAP, "_i"]).join(ends[1].hint("merge"), on=[SNAP, "_j"]).select(SNAP, "src", "dst")


def sample_per_group(df: DataFrame, group: Sequence[str], k: int, *, seed: int = 0, by: Sequence[str] = ("seq",)) -> DataFrame:
    """A seeded uniform sample of at most ``k`` rows per group (the sampling operator's own limit).

    Every task first keeps its own ``k`` lowest ranks of each group, so a hot group sends only ``k`` rows per task.
    """
    group = list(group)
    ranked = df.withColumn("_r", stable_rank(seed, *by))

    def local(batches):
        import pyarrow as pa

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > LOCAL_ROWS:
                held = _lowest(pa.Table.from_batches(held), group, k).to_batches()
                rows = 0
        if held:
            yield from _lowest(pa.Table.from_batches(held), group, k).to_batches()

    final = Window.partitionBy(*group).orderBy("_r")
    kept = ranked.mapInArrow(local, ranked.schema)
    return kept.withColumn("_k", F.row_number().over(final)).where(F.col("_k") <= k).drop("_r", "_k")


LOCAL_ROWS = 200_000  # rows a task gathers before it drops all but each group's lowest ranks


def _lowest(table, group: list[str], k: int):
    """The rows with the ``k`` lowest ranks of every group."""
    keys = table.select([*group, "_r"]).to_pandas()
    keys = keys.sort_values("_r", kind="stable")
    return table.take(keys.groupby(group, dropna=False, sort=False).head(k).index.to_numpy())


def close_pair_loss(vectors: DataFrame, *, eps: float, max_rows: int = 50, seed: int = 0, vector: str = "embedding") -> DataFrame:
    """Per sampled node: mean over the other sampled nodes of the distance, squared from ``eps`` on.

    At most ``max_rows`` nodes per snapshot take part, so a group is a small array.
    """
    sample = sample_per_group(vectors, [SNAP], max_rows, seed=seed, by=("node",))
    packed = sample.groupBy(SNAP).agg(F.collect_list(F.struct("node", F.col(vector).alias("v"))).alias("z"))
    distance = (
        "sqrt(aggregate(zip_with(a.v, b.v, (x, y) -> pow(cast(x AS double) - cast(y AS double), 2)), 0D, (s, x) -> s + x))"
    )
    return (
        packed.where("size(z) > 1")
        .selectExpr(SNAP, "z", "explode(z) AS a")
        .selectExpr(
            SNAP,
            "a.node AS node",
            f"transform(filter(z, b -> b.node <> a.node), b -> {distance}) AS d",
        )
        .selectExpr(
            SNAP,
            "node",
            f"aggregate(d, 0D, (s, x) -> s + CASE WHEN x < {eps!r}D THEN x ELSE x * x END) / size(d) AS loss",
        )
    )


def layer_scores(
    scores: DataFrame, layers: Sequence[str], *, batch: Sequence[str] = ("batch_id",), layer: str = "layer"
) -> DataFrame:
    """Highest score relative to its threshold per batch and layer, on the full batch x layer grid.

    A threshold of 0 makes a positive score infinite; a score of 0 then counts as none.

    Null where a layer has no rows or is still warming up (negative threshold). ``threshold`` is 1, or null
    for a batch in which no layer is ready.
    """
    best = scores.groupBy(*batch, layer).agg(
        F.max(
            F.when(F.col("threshold") > 0, F.try_divide("score", "threshold")).when(
                (F.col("threshold") == 0) & (F.col("score") > 0), float("inf")
            )
        ).alias("score")
    )
    grid = scores.select(*batch).distinct().withColumn(
        layer, F.explode(F.array(*[F.lit(name) for name in layers]))
    )
    full = grid.join(best, on=[*batch, layer], how="left")
    ready = F.max(F.when(F.col("score").isNotNull(), 1.0)).over(Window.partitionBy(*batch))
    return full.withColumn("threshold", ready)

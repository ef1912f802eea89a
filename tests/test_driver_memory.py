"""What the driver holds: small joins of loops are not broadcast."""

from tidewire.operators.graph_iter import components, lcc_ratio
from tidewire.operators.index import heavy_join
from tidewire.plans.chains import graph_feature_extraction, graph_feature_table


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_joins_of_loops_broadcast_nothing(spark):
    left = spark.createDataFrame([(i % 7, i) for i in range(100)], "k long, v long")
    right = spark.createDataFrame([(i, 2 * i) for i in range(7)], "k long, w long")
    joined = heavy_join(left, right, ["k"], spread=["v"])
    assert sorted((r.k, r.v, r.w) for r in joined.collect()) == sorted((i % 7, i, 2 * (i % 7)) for i in range(100))
    assert "Broadcast" not in _plan(joined)


def test_components_of_a_chain(spark):
    names = [f"n{i:02}" for i in range(20)]
    nodes = spark.createDataFrame([(0, n) for n in [*names, "z"]], "snapshot_id long, node string")
    edges = spark.createDataFrame([(0, a, b) for a, b in zip(names, names[1:])], "snapshot_id long, src string, dst string")
    got = {r.node: r.label for r in components(nodes, edges).collect()}
    assert got == {n: "n00" for n in names} | {"z": "z"}


def test_roots_are_the_components(spark):
    """Chains, a star, a ring, loops, nodes alone, edges to no node, nulls; two snapshots that share names."""
    names = [f"n{i:02}" for i in range(20)]
    chain, star, ring = list(zip(names, names[1:])), [("s0", f"s{i}") for i in range(1, 30)], [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)]
    odd = [("x", "x"), ("y", "gone"), ("z", "gone"), (None, "y"), ("z", None)]
    nodes = [(0, n) for pair in [*chain, *star, *ring] for n in pair] + [(0, "x"), (0, "y"), (0, "z"), (0, None), (None, "y")] + [(1, n) for n in names]
    edges = [(0, *e) for e in [*chain, *star, *ring, *odd]] + [(1, b, a) for a, b in chain[:9]]
    node_table = spark.createDataFrame(nodes, "snapshot_id long, node string")
    edge_table = spark.createDataFrame(edges, "snapshot_id long, src string, dst string")
    first = {n: "n00" for n in names} | {f"s{i}": "s0" for i in range(30)} | {f"r{i}": "r0" for i in range(9)} | {n: n for n in "xyz"}
    second = {n: "n00" if i < 10 else n for i, n in enumerate(names)}
    wanted = {(0, n): label for n, label in first.items()} | {(1, n): label for n, label in second.items()}
    found = components(node_table, edge_table).collect()
    assert len(found) == len(wanted) and {(r.snapshot_id, r.node): r.label for r in found} == wanted
    assert {r.snapshot_id: round(r.lcc_ratio * (62 if r.snapshot_id == 0 else 20)) for r in lcc_ratio(node_table, edge_table).collect()} == {0: 30, 1: 10}


def test_features_of_graphs_read_the_packets_once(spark):
    """The feature table is stored, so what reads it does not make the graphs again."""
    packets = spark.createDataFrame(
        [(0, "m1", "m2", "i1", "i2", "1", "2", 10.0), (0, "m1", "m3", "i1", "i3", "1", "3", 10.0)],
        "snapshot_id long, src_mac string, dst_mac string, src_ip string, dst_ip string, src_port string, dst_port string, packet_size double",
    )
    table = graph_feature_table(*graph_feature_extraction(packets))
    row = table.first()
    assert (row.num_nodes, row.lcc_ratio) == (9, 1.0)
    assert "Generate" not in _plan(table)

"""Graphs are made once, and random non-edges are drawn without listing the walk against the edges."""

from pyspark.sql import functions as F

from tidewire.operators import graph as G
from tidewire.plans.chains import graph_feature_extraction, multilayer_graph_reconstruction

PACKETS = "snapshot_id long, src_mac string, dst_mac string, src_ip string, dst_ip string, src_port string, dst_port string, packet_size double"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_reconstruction_reads_the_packets_before_it_returns(spark, tmp_path):
    """Nulls, loops and a snapshot of one edge; the result reads stored tables only."""
    rows = [(0, f"m{i % 3}", f"m{i % 4}", f"i{i % 7}", f"i{i % 5}", f"{i % 6}", f"{i % 2}", 1.0 * i) for i in range(60)]
    rows += [(0, "m1", None, "i1", None, "1", None, 2.0), (1, "a", "b", "a", "b", "", "", 1.0), (None, "a", "b", "c", "d", "1", "2", 1.0)]
    spark.createDataFrame(rows, PACKETS).write.parquet(f"{tmp_path}/packets")
    nodes, edges = graph_feature_extraction(spark.read.parquet(f"{tmp_path}/packets"))
    found = multilayer_graph_reconstruction(nodes, edges)
    assert str(tmp_path) not in _plan(found)
    got = {r.snapshot_id: r for r in found.collect()}
    assert set(got) == {0, 1} and all(r.train_loss >= r.loss > 0 for r in got.values())


def _walked(spark, n: int, edges: set, goal: int) -> list:
    """The first ``goal`` non-edges on the walk, found by listing it whole."""
    places = spark.range(n * (n - 1)).selectExpr("0L AS snapshot_id", f"{n}L AS _n", "id AS _at", f"id div {n - 1} AS _i", f"id % {n - 1} AS _j")
    pairs = [(r._i, r._j + (r._j >= r._i)) for r in G._walk(places, 0, 6).orderBy("_at").collect()]
    assert len(set(pairs)) == n * (n - 1) and all(i != j and 0 <= j < n for i, j in pairs)
    return [p for p in pairs if p not in edges][:goal]


def test_draws_are_the_first_non_edges_of_the_walk(spark):
    """Also with loops, in graphs that leave fewer pairs than they have edges, and over several blocks."""
    for n, share in ((7, 2), (7, 45), (100, 3), (100, 80)):
        edges = {(i, j) for i in range(n) for j in range(n) if (i * 31 + j * 17) % 100 < share or i == j == 3}
        name = "n{:03}".format
        nodes = spark.createDataFrame([(0, name(i)) for i in range(n)], "snapshot_id long, node string")
        table = spark.createDataFrame([(0, name(i), name(j)) for i, j in edges], "snapshot_id long, src string, dst string")
        drawn = G.negative_edges(nodes, table)
        wanted = _walked(spark, n, edges, len(edges))
        assert sorted((r.src, r.dst) for r in drawn.collect()) == sorted((name(i), name(j)) for i, j in wanted)


def test_plan_of_draws_stays_short(spark):
    """A filter pushed below the steps of the walk doubled its text with each; the pairs themselves are not broadcast."""
    pairs = [(0, f"n{i}", f"n{i * 7 % 30}") for i in range(30)]
    nodes = spark.createDataFrame([(0, f"n{i}") for i in range(30)], "snapshot_id long, node string")
    drawn = G.negative_edges(nodes, spark.createDataFrame(pairs, "snapshot_id long, src string, dst string"))
    counted = drawn.agg(F.count("src"), F.count("dst"))
    assert max(map(len, _plan(counted).splitlines())) < 2_000
    assert "SortMergeJoin" in _plan(counted)

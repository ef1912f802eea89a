"""Queries of graph snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import graph as G
from tidewire.operators import graph_iter as GI
from tidewire.operators import live_graph as L
from tidewire.operators.index import first_seen_ids
from tidewire.operators.traffic import expired_links, layer_id_sql
from tidewire.operators.windows import anchored_windows, tumbling_snapshots
from tidewire.plans.registry import query, r, rounded
from tidewire.schema import PROTOCOL_IDS, packets, table

SNAP = "snapshot_id"
S = "CAST(floor(t) AS BIGINT) AS snapshot_id"
EDGES = f"edges AS (SELECT DISTINCT {S}, src_ip AS src, dst_ip AS dst FROM packets)"
UNDIRECTED = (
    "und AS (SELECT DISTINCT CAST(floor(t * 32) AS BIGINT) AS snapshot_id, least(src_mac, dst_mac) AS src,"
    " greatest(src_mac, dst_mac) AS dst FROM packets)"
)
UND_NODES = "und_nodes AS (SELECT snapshot_id, src AS node FROM und UNION SELECT snapshot_id, dst FROM und)"


def snapshots(spark, sf):
    return tumbling_snapshots(packets(spark, sf), 1.0)


def ip_edges(spark, sf):
    return G.layer_edges(snapshots(spark, sf), "internet")


def sparse_graph(spark, sf):
    """Undirected graphs of snapshots so short that they fall into components."""
    edges = G.undirected(G.layer_edges(tumbling_snapshots(packets(spark, sf), 1 / 32), "physical"))
    nodes = edges.select(SNAP, F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes, edges


@query(
    "layer_graph_nodes",
    f"""WITH {{packets}}, ends AS (
        SELECT {S}, src_ip || ':' || src_port AS node, -1 AS sign, packet_size FROM packets UNION ALL
        SELECT {S}, dst_ip || ':' || dst_port, 1, packet_size FROM packets)
      SELECT snapshot_id, node, CAST(sum(sign) AS BIGINT) AS count, {r("sum(sign * packet_size)", "size", 4)}
      FROM ends GROUP BY ALL""",
)
def layer_graph_nodes(spark, sf):
    return rounded(G.layer_nodes(snapshots(spark, sf), "transport"), 4)


@query(
    "layer_graph_edges",
    f"WITH {{packets}} SELECT DISTINCT {S}, src_mac AS src, dst_mac AS dst FROM packets",
)
def layer_graph_edges(spark, sf):
    return G.layer_edges(snapshots(spark, sf), "physical")


_SS, _DS = "src_ip || ':' || src_port", "dst_ip || ':' || dst_port"


MULTILAYER = f"""e AS (
      SELECT {S}, src_mac AS src, dst_mac AS dst, packet_size AS size FROM packets UNION ALL
      SELECT {S}, src_ip, dst_ip, packet_size FROM packets UNION ALL
      SELECT {S}, src_ip, src_mac, packet_size FROM packets UNION ALL
      SELECT {S}, dst_mac, dst_ip, packet_size FROM packets UNION ALL
      SELECT {S}, {_SS}, {_DS}, 0 FROM packets WHERE src_port <> '' AND dst_port <> '' UNION ALL
      SELECT {S}, {_SS}, src_ip, 0 FROM packets WHERE src_port <> '' AND dst_port <> '' UNION ALL
      SELECT {S}, dst_ip, {_DS}, packet_size FROM packets WHERE src_port <> '' AND dst_port <> '')"""
NODES = f"""SELECT {S}, src_mac AS node, 'Physical' AS layer FROM packets
      UNION SELECT {S}, dst_mac, 'Physical' FROM packets
      UNION SELECT {S}, src_ip, 'Internet' FROM packets UNION SELECT {S}, dst_ip, 'Internet' FROM packets
      UNION SELECT {S}, {_SS}, 'Transport' FROM packets WHERE src_port <> '' AND dst_port <> ''
      UNION SELECT {S}, {_DS}, 'Transport' FROM packets WHERE src_port <> '' AND dst_port <> ''"""


@query(
    "multilayer_graph_edges",
    f"""WITH {{packets}}, {MULTILAYER}
      SELECT snapshot_id, src, dst, {r("sum(size)", "size", 4)}, count(*) AS count FROM e GROUP BY ALL""",
)
def multilayer_graph_edges(spark, sf):
    return rounded(G.multilayer_edges(snapshots(spark, sf)), 4)


@query(
    "multilayer_graph_nodes",
    f"WITH {{packets}} {NODES}",
)
def multilayer_graph_nodes(spark, sf):
    return G.multilayer_nodes(snapshots(spark, sf))


@query(
    "undirected_edges",
    f"WITH {{packets}} SELECT DISTINCT {S}, least(src_ip, dst_ip) AS src, greatest(src_ip, dst_ip) AS dst FROM packets",
)
def undirected_edges(spark, sf):
    return G.undirected(G.plain(ip_edges(spark, sf)))


@query(
    "drop_silent_nodes",
    f"""WITH {{packets}}, ends AS (
        SELECT {S}, src_mac AS node, -1 AS sign, floor(packet_size) AS size FROM packets UNION ALL
        SELECT {S}, dst_mac, 1, floor(packet_size) FROM packets),
      nodes AS (SELECT snapshot_id, node FROM ends GROUP BY ALL HAVING NOT (sum(sign) = 0 AND sum(sign * size) = 0)),
      e AS (SELECT DISTINCT {S}, src_mac AS src, dst_mac AS dst FROM packets)
      SELECT e.* FROM e JOIN nodes a ON a.snapshot_id = e.snapshot_id AND a.node = e.src
        JOIN nodes b ON b.snapshot_id = e.snapshot_id AND b.node = e.dst""",
)
def drop_silent_nodes(spark, sf):
    rows = snapshots(spark, sf).withColumn("packet_size", F.floor("packet_size"))
    return G.drop_silent_nodes(G.layer_nodes(rows), G.layer_edges(rows))[1]


@query(
    "edge_positions",
    f"""WITH {{packets}}, pos AS (SELECT src_ip AS src, dst_ip AS dst, min(seq) AS position FROM packets
        WHERE file = 'benign_0' GROUP BY ALL)
      SELECT seq, src_ip AS src, dst_ip AS dst, coalesce(position, -1) AS position, position IS NOT NULL AS exists
      FROM packets LEFT JOIN pos ON src = src_ip AND dst = dst_ip""",
)
def edge_positions(spark, sf):
    view = packets(spark, sf).selectExpr("seq", "src_ip AS src", "dst_ip AS dst", "file")
    known = view.where("file = 'benign_0'").groupBy("src", "dst").agg(F.min("seq").alias("position"))
    return G.edge_positions(known, view.drop("file"))


@query(
    "complete_pair_count",
    f"""WITH {{packets}}, n AS (SELECT {S}, src_ip AS node FROM packets UNION SELECT {S}, dst_ip FROM packets)
      SELECT snapshot_id, count(*) AS nodes, count(*) * (count(*) - 1) AS pairs FROM n GROUP BY ALL""",
)
def complete_pair_count(spark, sf):
    edges = ip_edges(spark, sf)
    return G.complete_pair_count(edges.select(SNAP, F.explode(F.array("src", "dst")).alias("node")).distinct())


@query(
    "degree_features",
    f"""WITH {{packets}}, {UNDIRECTED}, {UND_NODES},
      ends AS (SELECT snapshot_id, src AS node FROM und UNION ALL SELECT snapshot_id, dst FROM und),
      deg AS (SELECT snapshot_id, node, count(*) AS d FROM ends GROUP BY ALL),
      nn AS (SELECT snapshot_id, count(*) AS n FROM und_nodes GROUP BY ALL),
      ee AS (SELECT snapshot_id, count(*) AS e FROM und GROUP BY ALL)
      SELECT snapshot_id, n AS num_nodes, e AS num_edges,
        {r("CASE WHEN n <= 1 THEN 0 ELSE 2.0 * e / (n * (n - 1)) END", "edge_density")},
        {r("2.0 * e / n", "mean_degree")}, {r("var_pop(d)", "degree_variance")}, max(d) AS max_degree
      FROM deg JOIN nn USING (snapshot_id) JOIN ee USING (snapshot_id) GROUP BY snapshot_id, n, e""",
)
def degree_features(spark, sf):
    return rounded(G.degree_features(*sparse_graph(spark, sf)))


_REACH = """adj AS (SELECT snapshot_id, src AS a, dst AS b FROM und UNION SELECT snapshot_id, dst, src FROM und),
      reach(snapshot_id, a, b) AS (SELECT snapshot_id, node, node FROM und_nodes UNION
        SELECT r.snapshot_id, r.a, adj.b FROM reach r JOIN adj ON adj.snapshot_id = r.snapshot_id AND adj.a = r.b)"""


@query(
    "largest_component_ratio",
    f"""WITH RECURSIVE {{packets}}, {UNDIRECTED}, {UND_NODES}, {_REACH},
      comp AS (SELECT snapshot_id, a, min(b) AS label FROM reach GROUP BY ALL),
      sizes AS (SELECT snapshot_id, label, count(*) AS size FROM comp GROUP BY ALL)
      SELECT snapshot_id, {r("max(size) / sum(size)", "lcc_ratio")} FROM sizes GROUP BY ALL""",
)
def largest_component_ratio(spark, sf):
    return rounded(GI.lcc_ratio(*sparse_graph(spark, sf)))


@query(
    "shortest_path_measures",
    f"""WITH RECURSIVE {{packets}}, {UNDIRECTED}, {UND_NODES}, {_REACH},
      comp AS (SELECT snapshot_id, a, min(b) AS label FROM reach GROUP BY ALL),
      sizes AS (SELECT snapshot_id, label, count(*) AS size FROM comp GROUP BY ALL),
      best AS (SELECT DISTINCT ON (snapshot_id) snapshot_id, label, size FROM sizes ORDER BY snapshot_id, size DESC, label),
      lcc AS (SELECT snapshot_id, a AS node, size FROM comp JOIN best USING (snapshot_id, label)),
      walk(snapshot_id, a, b, d) AS (SELECT snapshot_id, node, node, 0 FROM lcc UNION
        SELECT w.snapshot_id, w.a, adj.b, w.d + 1 FROM walk w JOIN adj ON adj.snapshot_id = w.snapshot_id AND adj.a = w.b
        WHERE w.d < 20),
      dist AS (SELECT snapshot_id, a, b, min(d) AS d FROM walk GROUP BY ALL)
      SELECT snapshot_id, {r("CASE WHEN max(size) > 1 THEN sum(d) / (max(size) * (max(size) - 1)) ELSE 0 END", "avg_shortest_path_length_lcc")},
        max(d) AS diameter_lcc FROM dist JOIN (SELECT DISTINCT snapshot_id, size FROM lcc) USING (snapshot_id) GROUP BY ALL""",
)
def shortest_path_measures(spark, sf):
    return rounded(GI.path_measures(*sparse_graph(spark, sf), words=1))


@query(
    "edge_jaccard",
    f"""WITH {{packets}}, e AS (SELECT DISTINCT {S}, src_mac AS src, dst_mac AS dst FROM packets),
      b AS (SELECT snapshot_id - 1 AS snapshot_id, src, dst, 1 AS y FROM e),
      j AS (SELECT snapshot_id, x, y FROM (SELECT *, 1 AS x FROM e) FULL JOIN b USING (snapshot_id, src, dst))
      SELECT snapshot_id, count(*) FILTER (x = 1 AND y = 1) AS shared, count(*) AS total,
        {r("count(*) FILTER (x = 1 AND y = 1) / count(*)", "iou")}
      FROM j GROUP BY ALL HAVING max(x) = 1 AND max(y) = 1""",
)
def edge_jaccard(spark, sf):
    return rounded(G.consecutive_jaccard(G.layer_edges(snapshots(spark, sf), "physical")))


_NODES2 = f"""{EDGES}, ends AS (SELECT {S}, src_ip AS node, -1 AS sign, packet_size FROM packets UNION ALL
        SELECT {S}, dst_ip, 1, packet_size FROM packets),
      nodes AS (SELECT snapshot_id, node, sum(sign) AS count, sum(sign * packet_size) AS size FROM ends GROUP BY ALL)"""


def _gcn_hop(source: str, target: str) -> str:
    return f"""{target} AS (SELECT n.snapshot_id, n.node, any_value(n.w) AS w,
        any_value(n.w) * (any_value(n.w * n.count) + coalesce(sum(m.w * m.count), 0)) AS count,
        any_value(n.w) * (any_value(n.w * n.size) + coalesce(sum(m.w * m.size), 0)) AS size
      FROM {source} n LEFT JOIN edges e ON e.snapshot_id = n.snapshot_id AND e.dst = n.node
      LEFT JOIN {source} m ON m.snapshot_id = e.snapshot_id AND m.node = e.src GROUP BY 1, 2)"""


@query(
    "neighbour_propagation",
    f"""WITH {{packets}}, {_NODES2},
      deg AS (SELECT snapshot_id, dst AS node, count(*) + 1 AS d FROM edges GROUP BY ALL),
      x0 AS (SELECT snapshot_id, node, 1 / sqrt(coalesce(d, 1)) AS w, count, size FROM nodes LEFT JOIN deg USING (snapshot_id, node)),
      {_gcn_hop("x0", "x1")}, {_gcn_hop("x1", "x2")}
      SELECT snapshot_id, node, {r("count", "count")}, {r("size", "size")} FROM x2""",
)
def neighbour_propagation(spark, sf):
    rows = snapshots(spark, sf)
    nodes, edges = G.layer_nodes(rows, "internet"), G.layer_edges(rows, "internet")
    out = G.propagate(nodes.withColumn("count", F.col("count").cast("double")), edges, ["count", "size"], hops=2)
    return rounded(out)


@query(
    "neighbour_sum_read_out",
    f"""WITH {{packets}}, {_NODES2},
      g AS (SELECT n.snapshot_id, n.node, any_value(n.size) + coalesce(sum(m.size), 0) AS size
        FROM nodes n LEFT JOIN edges e ON e.snapshot_id = n.snapshot_id AND e.dst = n.node
        LEFT JOIN nodes m ON m.snapshot_id = e.snapshot_id AND m.node = e.src GROUP BY 1, 2)
      SELECT snapshot_id, {r("sum(size)", "size_add")}, {r("avg(size)", "size_mean")} FROM g GROUP BY ALL""",
)
def neighbour_sum_read_out(spark, sf):
    rows = snapshots(spark, sf)
    summed = G.propagate(G.layer_nodes(rows, "internet"), G.layer_edges(rows, "internet"), ["size"], kind="gin")
    return rounded(G.read_out(summed, ["size"]))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").selectExpr("concat('u', cast(vec_id AS string)) AS node", "embedding")


@query(
    "edge_reconstruction_loss",
    f"""WITH {{packets}}, {EDGES}, v AS (SELECT 'u' || vec_id AS node, embedding FROM embeddings),
      s AS (SELECT snapshot_id, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s
        FROM edges JOIN v a ON a.node = src JOIN v b ON b.node = dst)
      SELECT snapshot_id, {r("avg(ln(1 + exp(-s)))", "loss")} FROM s GROUP BY ALL""",
)
def edge_reconstruction_loss(spark, sf):
    return rounded(G.reconstruction_loss(G.edge_scores(ip_edges(spark, sf), _vectors(spark, sf))))


@query(
    "negative_edges",
    f"""WITH {{packets}}, {EDGES}, n AS (SELECT snapshot_id, src AS node FROM edges UNION SELECT snapshot_id, dst FROM edges),
      k AS (SELECT snapshot_id, count(*) AS n FROM n GROUP BY ALL),
      e AS (SELECT snapshot_id, count(*) AS every, count(*) FILTER (src <> dst) AS own FROM edges GROUP BY ALL)
      SELECT snapshot_id, least(every, n * (n - 1) - own) AS drawn, CAST(0 AS BIGINT) AS existing, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS loops
      FROM e JOIN k USING (snapshot_id)""",
)
def negative_edges(spark, sf):
    """The draws are seeded; what SQL can check is their number, and that none exists, repeats or joins a node to itself."""
    edges = ip_edges(spark, sf).select(SNAP, "src", "dst").distinct()
    nodes = edges.select(SNAP, F.explode(F.array("src", "dst")).alias("node")).distinct()
    drawn = G.negative_edges(nodes, edges).groupBy(SNAP, "src", "dst").agg(F.count("*").alias("times"))
    known = edges.withColumn("known", F.lit(1))
    return drawn.join(known, [SNAP, "src", "dst"], "left").groupBy(SNAP).agg(
        F.sum("times").alias("drawn"),
        F.count("known").alias("existing"),
        F.count_if(F.col("times") > 1).alias("repeated"),
        F.count_if(F.col("src") == F.col("dst")).alias("loops"),
    )


@query(
    "close_pair_loss",
    f"""WITH s AS (SELECT *, CAST(label AS BIGINT) AS snapshot_id,
        row_number() OVER (PARTITION BY label ORDER BY md5('0:' || vec_id)) AS k FROM embeddings),
      d AS (SELECT a.snapshot_id, a.vec_id AS node, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d
        FROM s a JOIN s b ON a.snapshot_id = b.snapshot_id AND a.vec_id <> b.vec_id WHERE a.k <= 50 AND b.k <= 50)
      SELECT snapshot_id, node, {r("avg(CASE WHEN d < 1.4 THEN d ELSE d * d END)", "loss")} FROM d GROUP BY ALL""",
)
def close_pair_loss(spark, sf):
    vectors = table(spark, sf, "embeddings").selectExpr(
        "cast(label AS bigint) AS snapshot_id", "vec_id AS node", "embedding"
    )
    return rounded(G.close_pair_loss(vectors, eps=1.4, max_rows=50))


@query(
    "first_seen_ids",
    """WITH {packets}, n AS (SELECT src_ip AS node, seq FROM packets UNION ALL SELECT dst_ip, seq FROM packets),
      f AS (SELECT node, min(seq) AS first_seq FROM n GROUP BY ALL)
      SELECT node, first_seq, row_number() OVER (ORDER BY first_seq, node) - 1 AS node_id FROM f""",
)
def first_seen(spark, sf):
    ends = packets(spark, sf).select("seq", F.explode(F.array("src_ip", "dst_ip")).alias("node"))
    return first_seen_ids(ends, "node")


def changes(spark, sf):
    view = packets(spark, sf)
    ups = view.selectExpr(
        "batch_id", "seq", "1 AS type", "src_mac AS src", "dst_mac AS dst", f"{layer_id_sql()} AS protocol", "packet_size AS size"
    )
    gone = expired_links(view, rates=(5.0, 3.0)).selectExpr(
        "floor(seq / 1024) AS batch_id", "seq", "0 AS type", "src_id AS src", "dst_id AS dst", "protocol", "cast(null AS double) AS size"
    )
    # A deletion stands ahead of the upsert of the first packet after it.
    return ups.unionByName(gone)


_CHANGES = """base AS (SELECT *, CASE protocol WHEN 'TCP' THEN 0 WHEN 'UDP' THEN 1 WHEN 'ICMP' THEN 2
          WHEN 'ARP' THEN 3 ELSE 4 END AS layer FROM packets),
      w AS (SELECT a.seq, a.t, src_mac, dst_mac, layer, sum(pow(2, -3 * (a.t - b.t))) AS weight
            FROM base a JOIN base b USING (src_mac, dst_mac, layer) WHERE b.seq <= a.seq GROUP BY ALL),
      ex AS (SELECT *, t + log2(weight / 1e-3) / 3 AS ends,
              lead(t) OVER (PARTITION BY src_mac, dst_mac, layer ORDER BY seq) AS next_t FROM w),
      gone AS (SELECT pseq AS seq, src_mac, dst_mac, layer FROM ex ASOF JOIN (SELECT t AS pt, seq AS pseq FROM packets) p ON ex.ends < p.pt
              WHERE next_t IS NULL OR next_t > ends),
      changes AS (SELECT seq // 1024 AS batch_id, seq, 1 AS type, src_mac AS src, dst_mac AS dst, layer AS protocol, packet_size AS size FROM base
        UNION ALL SELECT seq // 1024, seq, 0, src_mac, dst_mac, layer, NULL FROM gone)"""


@query(
    "live_edges",
    f"""WITH {{packets}}, {_CHANGES},
      l AS (SELECT *, row_number() OVER (PARTITION BY protocol, src, dst ORDER BY batch_id DESC, seq DESC, type DESC) AS k
        FROM changes WHERE batch_id <= 6)
      SELECT protocol, src, dst, size FROM l WHERE k = 1 AND type = 1""",
)
def live_edges(spark, sf):
    return L.live_edges(changes(spark, sf), ["size"], as_of=6, stream=["protocol"])


@query(
    "live_nodes",
    f"""WITH {{packets}}, {_CHANGES},
      l AS (SELECT *, row_number() OVER (PARTITION BY protocol, src, dst ORDER BY batch_id DESC, seq DESC, type DESC) AS k FROM changes WHERE batch_id <= 6),
      e AS (SELECT protocol, src, dst FROM l WHERE k = 1 AND type = 1),
      roles AS (SELECT protocol, batch_id, seq, src AS node, 0 AS role, size FROM changes WHERE type = 1 AND batch_id <= 6
        UNION ALL SELECT protocol, batch_id, seq, dst, 1, -size FROM changes WHERE type = 1 AND batch_id <= 6),
      n AS (SELECT protocol, node, arg_max(size, seq * 2 + role) AS size FROM roles GROUP BY ALL)
      SELECT n.* FROM n WHERE EXISTS (SELECT 1 FROM e WHERE e.protocol = n.protocol AND (e.src = n.node OR e.dst = n.node))""",
)
def live_nodes(spark, sf):
    log = changes(spark, sf).withColumn("minus", -F.col("size"))
    return L.live_nodes(log, ["size"], ["minus"], ["size"], as_of=6, stream=["protocol"])


@query(
    "edge_versions",
    f"""WITH {{packets}}, {_CHANGES},
      b AS (SELECT protocol, src, dst, batch_id, arg_max(type, seq * 2 + type) AS type,
          arg_max(size, seq * 2 + type) AS size FROM changes GROUP BY ALL),
      v AS (SELECT *, lead(batch_id) OVER (PARTITION BY protocol, src, dst ORDER BY batch_id) AS to_batch FROM b)
      SELECT protocol, src, dst, batch_id AS from_batch, to_batch, size FROM v WHERE type = 1""",
)
def edge_versions(spark, sf):
    return L.edge_versions(changes(spark, sf), ["size"], stream=["protocol"])


@query(
    "layer_scores",
    f"""WITH {{packets}}, s AS (SELECT batch_id, protocol AS layer, packet_size AS score,
        CASE WHEN batch_id < 2 OR (protocol = 'ARP' AND batch_id < 4) THEN -1 ELSE 100 END AS threshold FROM packets),
      best AS (SELECT batch_id, layer, max(CASE WHEN threshold >= 0 THEN score / threshold END) AS score FROM s GROUP BY ALL),
      grid AS (SELECT batch_id, unnest({list(PROTOCOL_IDS)}) AS layer FROM (SELECT DISTINCT batch_id FROM s))
      SELECT batch_id, layer, {r("score", "score")},
        {r("max(CASE WHEN score IS NOT NULL THEN CAST(1 AS DOUBLE) END) OVER (PARTITION BY batch_id)", "threshold")}
      FROM grid LEFT JOIN best USING (batch_id, layer)""",
)
def layer_scores(spark, sf):
    warm = "CASE WHEN batch_id < 2 OR (protocol = 'ARP' AND batch_id < 4) THEN -1D ELSE 100D END AS threshold"
    scores = packets(spark, sf).selectExpr("batch_id", "protocol AS layer", "packet_size AS score", warm)
    return rounded(G.layer_scores(scores, list(PROTOCOL_IDS)))


@query(
    "anchored_windows",
    f"""WITH RECURSIVE {{packets}}, w(start, after, close) AS (
        SELECT min(t), -1, (SELECT min(seq) FROM packets WHERE t - (SELECT min(t) FROM packets) > 0.7) FROM packets
        UNION ALL SELECT c.t, w.close, (SELECT min(p.seq) FROM packets p WHERE p.seq > w.close AND p.t - c.t > 0.7)
        FROM w JOIN packets c ON c.seq = w.close)
      SELECT p.seq, {r("start", "window_start")}, {r("c.t", "window_end")} FROM w JOIN packets c ON c.seq = w.close
        JOIN packets p ON p.seq > w.after AND p.seq <= w.close""",
)
def anchored(spark, sf):
    return rounded(anchored_windows(packets(spark, sf), 0.7, chunk_rows=16_384))

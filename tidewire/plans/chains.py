"""Named chains of operators, and detection that starts from saved state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import detect as D
from tidewire.operators import evaluate as E
from tidewire.operators import graph as G
from tidewire.operators import graph_iter as GI
from tidewire.operators import prequential as PQ
from tidewire.operators.meta import service_names, traffic_records, without_time
from tidewire.operators.scale import batch_state, running_scale
from tidewire.operators.traffic import link_features, traffic_features
from tidewire.schema import BATCH_ROWS, PROTOCOL_IDS, QUEUE_ROWS
from tidewire.session import settle


def metadata_extraction(headers: DataFrame, services: DataFrame | None = None, known: Sequence[str] = ()) -> DataFrame:
    """Decoded headers to traffic records."""
    records = traffic_records(headers)
    return service_names(records, services, known) if services is not None else records


def feature_extraction(packets: DataFrame, *, form: str = "tabular", **options) -> DataFrame:
    """Traffic records to statistics: ``tabular`` or ``link``."""
    return (traffic_features if form == "tabular" else link_features)(packets, **options)


def graph_feature_extraction(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Traffic records with ``snapshot_id`` to three-layer snapshots."""
    return G.multilayer_nodes(packets), G.multilayer_edges(packets)


def _judged(scored: DataFrame, *, stream: Sequence[str], warmup: int, by: Sequence[str], rows_per_batch: int = BATCH_ROWS) -> DataFrame:
    scored = settle(scored.select(*stream, "seq", "batch_id", "score"))  # read by both sides of the join below
    thresholds = D.rolling_threshold(
        scored, stream=stream, warmup=warmup, rows_per_batch=rows_per_batch
    )
    return E.batch_metrics(scored.join(thresholds, on=[*stream, "batch_id"]), by=by)


def basic_detection(features: DataFrame, names: Sequence[str], *, warmup: int) -> DataFrame:
    """Deviation score, rolling threshold, batch metrics."""
    scored = D.deviation_scores(features.select("seq", "batch_id", *names), names)
    return _judged(scored, stream=[], warmup=warmup, by=["batch_id"])


def scaled_detection(features: DataFrame, names: Sequence[str], *, latent: int, warmup: int) -> DataFrame:
    """Time removed, running quantile scaling, linear reconstruction error, threshold, metrics; all by earlier batches only."""
    rows = without_time(features).select("seq", "batch_id", *names)
    scaled = running_scale(rows, names)
    scored = PQ.reconstruction_stream(scaled, names, latent)
    return _judged(scored, stream=[], warmup=warmup, by=["batch_id"])


def graph_detection(snapshots: DataFrame, names: Sequence[str], *, rows_per_batch: int, warmup: int) -> DataFrame:
    """Detection on one row per snapshot; ``seq`` numbers the snapshots."""
    rows = snapshots.withColumn("batch_id", F.floor(F.col("seq") / F.lit(rows_per_batch)))
    scored = D.deviation_scores(rows.select("seq", "batch_id", *names), names)
    return _judged(scored, stream=[], warmup=warmup, by=["batch_id"], rows_per_batch=rows_per_batch)


def layered_detection(links: DataFrame, names: Sequence[str], *, warmup: int) -> DataFrame:
    """Per layer: scaling, scores and thresholds; then the layers' relative scores and their metrics.

    ``links`` has ``seq, batch_id, protocol`` (layer number), ``src_id, dst_id`` and features; the layer is a
    grouping column, so all layers run in one plan.
    """
    scaled = running_scale(links.select("seq", "batch_id", "protocol", "src_id", "dst_id", *names), names, stream=["protocol"])
    # The live graph of a batch: neighbour sums of the scaled edge features at each source node.
    around = scaled.groupBy("protocol", "batch_id", "dst_id").agg(*[F.avg(f).alias(f"n_{f}") for f in names])
    joined = scaled.join(around, on=["protocol", "batch_id", "dst_id"])
    mixed = [f"abs({f} + n_{f}) / 2" for f in names]
    scored = joined.selectExpr(
        "seq", "batch_id", "protocol", f"greatest({', '.join(mixed)}, 0D) AS score"
    )
    judged = D.adaptive_threshold(scored, stream=["protocol"], warmup=warmup).selectExpr(
        "batch_id", "cast(protocol AS string) AS layer", "score", "threshold"
    )
    layers = G.layer_scores(judged, [str(i) for i in PROTOCOL_IDS.values()])
    return E.batch_metrics(layers, by=["batch_id"])


def graph_feature_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Structural features per snapshot of the undirected graph, with the largest component's share.

    Both the features and the components read the graph, so it is stored first; a row per snapshot comes out, stored as well.
    """
    nodes, plain = settle(nodes.select(G.SNAP, "node")), settle(G.undirected(edges))
    features = G.degree_features(nodes, plain)
    return settle(features.join(GI.lcc_ratio(nodes, plain), on=G.SNAP))


def multilayer_graph_features(nodes: DataFrame, edges: DataFrame, *, rows_per_batch: int, warmup: int) -> DataFrame:
    """Three-layer snapshots, structural features, deviation score, metrics."""
    table = graph_feature_table(nodes, edges)
    first = table.select(F.min(G.SNAP).alias("m")).scalar()
    numbered = table.withColumn("seq", F.col(G.SNAP) - first)
    names = ["num_nodes", "num_edges", "edge_density", "mean_degree", "degree_variance", "max_degree", "lcc_ratio"]
    return graph_detection(numbered, names, rows_per_batch=rows_per_batch, warmup=warmup)


def multilayer_graph_reconstruction(nodes: DataFrame, edges: DataFrame, *, seed: int = 0) -> DataFrame:
    """Snapshot score: how badly the edges are explained by the neighbourhood sizes of their ends.

    ``loss`` is the score, from the edges alone; ``train_loss`` adds the loss of as many random pairs without an edge, which a model
    in training would lower. ``edges`` are distinct. Nodes and edges are made once and stored with hashed ids, and the joins that
    bring the ends' values to the edges also bring the node numbers from which the pairs without an edge are drawn.
    """
    numbers, salt = GI.hashed(G.numbered_nodes(nodes))
    named = numbers.where(F.col("node").isNotNull()).select(G.SNAP, F.col("id").alias("node"), "node_no")
    ids = [F.when(F.col(end).isNotNull(), F.xxhash64(F.lit(salt), end)).alias(end) for end in ("src", "dst")]
    links = settle(edges.select(G.SNAP, *ids, "count"))
    into = links.groupBy(G.SNAP, F.col("dst").alias("node")).agg(F.sum("count").alias("_c"), F.count("*").alias("_in"))
    sized = named.join(into, on=[G.SNAP, "node"], how="left").select(
        G.SNAP, "node", "_in", F.log1p(F.coalesce(F.col("_c").cast("double"), F.lit(0.0))).alias("x")
    )
    spread = settle(G.propagate(sized, links, ["x"], hops=2, degree="_in").join(named, on=[G.SNAP, "node"]))

    def scored(pairs: DataFrame, ends: dict[str, str], key: str) -> DataFrame:
        for (end, number), x in zip(ends.items(), ("_a", "_b"), strict=True):
            values = {end: F.col(key), number: F.col("node_no"), x: F.col("x")}
            pairs = pairs.join(spread.select(G.SNAP, *[c.alias(name) for name, c in values.items()]).hint("merge"), on=[G.SNAP, end])
        return pairs.select(G.SNAP, "_i", "_j", (F.col("_a") * F.col("_b")).alias("edge_score"))

    known = settle(scored(links.select(G.SNAP, "src", "dst"), {"src": "_i", "dst": "_j"}, "node"))
    sizes = numbers.groupBy(G.SNAP).agg(F.count("*").alias("_n")).join(G.edge_counts(links), on=G.SNAP)
    drawn = G.negative_pairs(sizes, known.select(G.SNAP, "_i", "_j"), seed=seed)
    missing = G.reconstruction_loss(scored(drawn, {"_i": "_i", "_j": "_j"}, "node_no"), exists=False).withColumnRenamed("loss", "_missing")
    both = G.reconstruction_loss(known).join(missing, G.SNAP, "left")
    return both.select(G.SNAP, "loss", (F.col("loss") + F.coalesce("_missing", F.lit(0.0))).alias("train_loss"))


# Detection from saved state: fit on the benign file, start every attack file from there.


def fit_detector(benign: DataFrame, names: Sequence[str], state_path: str, *, queue: int = QUEUE_ROWS) -> None:
    """Store the benign file's value counts and its last scores as tables."""
    batch_state(benign, names).write.mode("overwrite").parquet(f"{state_path}/quantiles")
    scored = D.deviation_scores(benign.select("seq", "batch_id", *names), names)
    last = scored.orderBy(F.desc("seq")).limit(queue).select("seq", "score")
    last.write.mode("overwrite").parquet(f"{state_path}/scores")


def apply_detector(
    attacks: DataFrame, names: Sequence[str], state_path: str, *, p: float = 0.99, queue: int = QUEUE_ROWS
) -> DataFrame:
    """Score all attack files in one job, each continuing from the saved benign state.

    ``attacks`` has ``file, seq, batch_id`` with rows and batches numbered from 0 per file. The saved values
    are counted once for all files; at most ``queue`` scores are copied to every file.
    """
    spark = attacks.sparkSession
    state = spark.read.parquet(f"{state_path}/quantiles")
    scored = settle(D.deviation_scores(attacks.select("file", "seq", "batch_id", *names), names, stream=["file"], initial=state))
    # At most ``queue`` scores: one row, copied to every file; the last one stands just before the file's first row.
    tail = spark.read.parquet(f"{state_path}/scores")
    packed = tail.agg(F.collect_list(F.struct((F.col("seq") - tail.agg(F.max("seq")).scalar() - 1).alias("seq"), "score"))).scalar()
    before = scored.select("file").distinct().select("file", F.inline(packed)).select("file", "seq", F.lit(None).cast("long").alias("batch_id"), "score")
    history = scored.select("file", "seq", "batch_id", "score").unionByName(before)
    thresholds = D.rolling_threshold(history, stream=["file"], queue=queue, p=p, warmup=0)
    return scored.join(thresholds, on=["file", "batch_id"]).select("file", "seq", "batch_id", "score", "threshold")

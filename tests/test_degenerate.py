"""Batches, files and features without spread, scores or positives."""

import math

from tidewire.operators import drift, evaluate, graph, linear

METRICS = "file string, batch_id long, pos_count long, batch_size long, median_score double"


def test_evaluation_without_scores_or_positives(spark):
    rows = [("benign_a", 0, 1, 4, 0.5), ("benign_a", 1, 0, 0, None), ("attack_a", 0, 0, 0, None), ("attack_a", 1, 3, 4, 2.0)]
    metrics = spark.createDataFrame(rows, METRICS)
    one = evaluate.run_statistics(metrics).first()
    assert (one.acc_benign, one.acc_malicious, one.f1) == (0.75, 0.75, 6 / 8)
    empty = spark.createDataFrame([("attack_b", 0, 0, 0, None)], METRICS)
    assert evaluate.file_accuracy(empty).first().accuracy is None
    ranked = spark.createDataFrame([(0.5, 0), (0.7, 0)], "score double, label int")
    assert evaluate.average_precision(ranked, by=[]).first().ap == 0.0


def test_constant_scores_and_features(spark):
    scores = spark.createDataFrame([(0, "a", i, 1.0) for i in range(3)], "batch_id long, model string, seq long, score double")
    base = spark.createDataFrame([("a", 1.0, 1.0, 1.0)], "model string, last_mean double, last_min double, last_max double")
    assert math.isnan(drift.pool_reliability(scores, base).first().reliability)
    assert all(math.isnan(r.score) for r in drift.pool_scores(scores, base).collect())
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert math.isnan(linear.linear_cka(flat, ["x"], ["y"]).first().cka)


def test_threshold_zero(spark):
    scores = spark.createDataFrame([(0, "l", 2.0, 0.0), (1, "l", 0.0, 0.0), (2, "l", 3.0, -1.0)], "batch_id long, layer string, score double, threshold double")
    got = {r.batch_id: (r.score, r.threshold) for r in graph.layer_scores(scores, ["l"]).collect()}
    assert got == {0: (math.inf, 1.0), 1: (None, None), 2: (None, None)}


def test_negative_edges_on_dense_graphs(spark):
    names = [f"n{i}" for i in range(6)]
    pairs = [(0, a, b) for a in names for b in names if a != b]
    nodes = spark.createDataFrame([(0, n) for n in names], "snapshot_id long, node string")
    for kept in (5, 20, 28, 30):
        edges = spark.createDataFrame(pairs[:kept], "snapshot_id long, src string, dst string")
        found = graph.negative_edges(nodes, edges).collect()
        assert len(found) == min(kept, 30 - kept) == len(set(found))
        assert not {tuple(r) for r in found} & set(pairs[:kept])

"""Order-dependent operators against plain loops, whole and in pieces."""

import random
from collections import deque

import numpy as np
import pytest

from tidewire.operators.detect import (
    adaptive_threshold,
    correlation_clusters,
    ensemble_scores,
    one_class_svm,
    reconstruction_scores,
)
from tidewire.operators.drift import drift_levels
from tidewire.operators.linear import Moments
from tidewire.operators.windows import anchored_windows


def loop_threshold(scores, rows, queue, warmup):
    kept, out = deque(maxlen=queue), []
    for number in range(0, len(scores), rows):
        batch = np.array(scores[number : number + rows])
        done = number // rows
        threshold = float(np.quantile(kept, 0.99)) if done >= warmup else -1.0
        if done < warmup * 0.8:
            pass
        elif done < warmup:
            kept.extend(batch)
        else:
            kept.extend(batch[batch < 2 * threshold])
        out += [threshold] * len(batch)
    return out


@pytest.mark.parametrize("chunk", [1000, 7, 3])
def test_adaptive_threshold(spark, chunk):
    rng = random.Random(5)
    scores = [rng.expovariate(0.2) * (8 if 300 < i < 420 else 1) for i in range(800)]
    wanted = loop_threshold(scores, 16, 100, 10)
    df = spark.createDataFrame([(i, i // 16, s) for i, s in enumerate(scores)], "seq long, batch_id long, score double")
    found = adaptive_threshold(df, queue=100, warmup=10, chunk_batches=chunk).orderBy("seq").collect()
    assert [r["threshold"] for r in found] == pytest.approx(wanted)


@pytest.mark.parametrize("seed", [1, 2])
def test_drift_levels(spark, seed):
    """Against two queues that take every value in turn."""
    rng, patience = random.Random(seed), 10
    level, rows, wanted = 1.0, [], {}
    usual, suspicious, since, models = deque(maxlen=patience), deque(maxlen=patience), 0, 1
    for b in range(260):
        if rng.random() < 0.06:
            level = rng.choice((1.0, 6.0, 9.0, 30.0))
        scores = [level + rng.random() * 3 for _ in range(rng.randrange(2, 6))]
        rows += [("x", b * 2, len(rows) + i, s, 5.0) for i, s in enumerate(scores)]
        median = float(np.median(scores))
        if median > 5.0:
            suspicious.append(median)
            since = 0
        else:
            usual.append(median)
            since += 1
        if since > patience // 5:
            suspicious.clear()
        magnitude, kind = 0.0, "none"
        if len(usual) == len(suspicious) == patience:
            low = min(np.percentile(suspicious, 1), np.percentile(usual, 1))
            high = max(np.percentile(suspicious, 99), np.percentile(usual, 99))
            magnitude = patience * (np.median(suspicious) - np.median(usual)) ** 2 / (high - low) ** 2
            kind = "malicious" if magnitude > 0.1 else "benign"
            models = min(20, models + (kind == "benign"))
            suspicious.clear()
        usual.extend(scores)
        wanted[b * 2] = (pytest.approx(magnitude), kind, models)
    rows += [("y", 0, 0, 1.0, 5.0), ("y", 0, 1, None, 5.0), ("z", 3, 0, None, 5.0)]
    df = spark.createDataFrame(rows, "file string, batch_id long, seq long, score double, threshold double")
    found = drift_levels(df, stream=["file"], patience=patience, confidence=0.1).collect()
    assert {r.batch_id: (r.drift_level, r.drift, r.num_model) for r in found if r.file == "x"} == wanted
    assert {"malicious", "benign"} <= {v[1] for v in wanted.values()}
    assert [(r.batch_id, r.drift_level, r.drift, r.num_model) for r in found if r.file == "y"] == [(0, 0.0, "none", 1)]



@pytest.mark.parametrize("chunk", [1000, 9])
def test_anchored_windows(spark, chunk):
    rng = random.Random(8)
    t, times = 0.0, []
    for _ in range(120):
        t += rng.random()
        times.append(t)
    start, wanted, pending = times[0], {}, []
    for i, at in enumerate(times):
        pending.append(i)
        if at - start > 2.5:
            wanted |= {j: (start, at) for j in pending}
            start, pending = at, []
    # Rows come in any order, and their numbers do not follow the time.
    rows = [(name, 500 - i, t + shift) for name, shift in (("a", 0.0), ("b", 100.0)) for i, t in enumerate(times)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "file string, seq long, t double")
    found = anchored_windows(df, 2.5, stream=["file"], chunk_rows=chunk).collect()
    got = {(r["file"], 500 - r["seq"]): (r["window_start"], r["window_end"]) for r in found}
    assert got.keys() == {(f, i) for f in "ab" for i in wanted}
    assert all(got["a", i] == pytest.approx(w) and got["b", i] == pytest.approx((w[0] + 100, w[1] + 100)) for i, w in wanted.items())


def test_anchored_windows_of_dense_rows(spark):
    """Windows of more rows than a piece, equal times, and starts that never meet: the pieces' steps are joined level by level."""
    rng = random.Random(3)
    times = sorted(round(rng.random() * 40, 2) for _ in range(900))
    start, wanted, pending = times[0], {}, []
    for i, at in enumerate(times):
        pending.append(i)
        if at - start > 1.7:
            wanted |= {j: (start, at) for j in pending}
            start, pending = at, []
    df = spark.createDataFrame(list(enumerate(times)), "seq long, t double")
    spark.sparkContext.setJobGroup("dense windows", "dense windows")
    found = {r["seq"]: (r["window_start"], r["window_end"]) for r in anchored_windows(df, 1.7, chunk_rows=11, fan=3).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("dense windows"))
    assert found == wanted
    assert jobs < 60  # 82 pieces; not a round of jobs for each


def test_fold_input_is_made_once(spark):
    """Rounds read a stored table; they do not do again what leads to the scores."""
    rng = random.Random(5)
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for rows in batches:
            made.add(len(rows))
            yield rows

    df = spark.createDataFrame([(i, i // 10, rng.random()) for i in range(600)], "seq long, batch_id long, score double")
    out = adaptive_threshold(df.mapInPandas(counted, df.schema), queue=100, warmup=10, chunk_batches=8)
    assert out.count() == 600 and made.value == 600


def test_clusters_respect_sizes():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(500, 3))
    x = np.hstack([base[:, [i % 3]] + 0.1 * rng.normal(size=(500, 1)) for i in range(15)])
    groups = correlation_clusters(Moments(500, x.sum(0), x.T @ x), 6)
    assert sorted(i for g in groups for i in g) == list(range(15))
    assert sorted(map(len, groups)) == [5, 5, 5]
    assert all(len({i % 3 for i in g}) == 1 for g in groups)


def test_models_score_odd_rows_higher(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 2))
    x = np.hstack([base, base @ rng.normal(size=(2, 8)) + 0.05 * rng.normal(size=(400, 8))])
    x[7] = rng.normal(size=10) * 6
    names = [f"f{i}" for i in range(10)]
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], ["id", *names])
    # The regular rows span two directions; a third axis would be spent on the odd row itself.
    top = reconstruction_scores(df, names, 2).orderBy("score", ascending=False).first()
    assert top["id"] == 7
    scores = [r["score"] for r in ensemble_scores(df, names, max_size=5).collect()]
    assert len(scores) == 400 and np.isfinite(scores).all()
    w, rho = one_class_svm(df, names, iterations=5)
    assert np.isfinite(w).all() and np.isfinite(rho)

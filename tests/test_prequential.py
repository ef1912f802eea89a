"""Models of earlier batches against plain loops over the batches."""

from collections import deque

import numpy as np
import pytest

from tidewire.operators import prequential as P
from tidewire.operators.scan import exclusive_scan


def data(n, d, seed=1, missing=0.05):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 3
    rows = [(i, i // 8, [None if rng.random() < missing / d else float(v) for v in row]) for i, row in enumerate(x)]
    return [r for r in rows if r[1] != 4]  # a gap in the batch numbers


def frame(spark, rows, d, streams=1):
    names = [f"x{i}" for i in range(d)]
    table = [(f"s{s}", i, b, *x) for s in range(streams) for i, b, x in rows[s * 3 :]]
    return spark.createDataFrame(table, "file string, seq long, batch_id long, " + ", ".join(f"{n} double" for n in names)), names


def errors(before, x, k):
    """Mean squared distance of the rows from the plane of the k leading axes of ``before``."""
    mean = before.mean(axis=0)
    axes = np.linalg.svd(before - mean, full_matrices=True)[2][:k]
    gap = x - mean
    return ((gap - gap @ axes.T @ axes) ** 2).mean(axis=1)


def test_scan(spark):
    table = [("a", i * 2, [1.0, float(i)]) for i in range(50)] + [("b", 7, [2.0, 5.0])]
    df = spark.createDataFrame(table, "file string, position long, state array<double>")
    out = exclusive_scan(df, lambda a, b: np.concatenate(([a[0] + b[0]], [b[1]])), stream=["file"], fan=4).collect()
    got = {(r.file, r.position): r.before for r in out}
    assert got == {("a", i * 2): [float(i), float(i - 1)] if i else None for i in range(50)} | {("b", 7): None}


@pytest.mark.parametrize("block", [1, 3, 50])
def test_reconstruction(spark, block):
    d, k = 4, 2
    rows = data(120, d)
    df, names = frame(spark, rows, d, streams=2)
    out = P.reconstruction_stream(df, names, k, stream=["file"], block_batches=block).collect()
    assert len(out) == df.count()
    for s in range(2):
        got = {r.seq: r.score for r in out if r.file == f"s{s}"}
        held = []
        for b in sorted({r[1] for r in rows[s * 3 :]}):
            own = [(i, x) for i, n, x in rows[s * 3 :] if n == b]
            whole = [(i, x) for i, x in own if None not in x]
            wanted = dict.fromkeys(i for i, _ in own)
            if held:
                wanted |= dict(zip([i for i, _ in whole], errors(np.array(held), np.array([x for _, x in whole]), k), strict=True))
            for i, v in wanted.items():
                assert got[i] == (None if v is None else pytest.approx(v, abs=1e-9)), (i, b)
            held += [x for _, x in whole]


def test_transformations(spark):
    rows = data(100, 3, missing=0)
    df, names = frame(spark, rows, 3)
    got = {r.seq: r.score for r in P.transformation_stream(df, names, transforms=5, dim=2, block_batches=4).collect()}
    weights, means = np.random.default_rng(0).normal(size=(5, 3, 2)), []
    for b in sorted({r[1] for r in rows}):
        own = [(i, np.array(x)) for i, n, x in rows if n == b]
        for i, x in own:
            if not means:
                assert got[i] is None
                continue
            centre = np.mean(means, axis=0)
            d = np.array([[((x - 0) @ weights[t] - centre @ weights[u]) @ ((x - 0) @ weights[t] - centre @ weights[u]) for u in range(5)] for t in range(5)])
            assert got[i] == pytest.approx(sum(d[t, t] + np.log(np.exp(-d[t]).sum()) for t in range(5)))
        means.append(np.mean([x for _, x in own], axis=0))


def test_ensemble(spark):
    d = 6
    rows = data(160, d, missing=0)
    df, names = frame(spark, rows, d)
    groups = P.warmup_clusters(df, names, warmup=3, max_size=3, min_size=2)
    assert sorted(i for g in groups for i in g) == list(range(d))
    got = {r.seq: r.score for r in P.ensemble_stream(df, names, warmup=3, max_size=3, clusters=groups, block_batches=2).collect()}
    held, heads = [], []
    for b in sorted({r[1] for r in rows}):
        own = [(i, x) for i, n, x in rows if n == b]
        x = np.array([x for _, x in own])
        vectors = None
        if held:
            vectors = np.stack([np.sqrt(errors(np.array(held)[:, g], x[:, g], P.latent(len(g), 0.75)) + 1e-7) for g in groups], axis=1)
        for j, (i, _) in enumerate(own):
            if not heads:
                assert got[i] is None
            else:
                assert got[i] == pytest.approx(np.sqrt(errors(np.array(heads), vectors[j : j + 1], P.latent(len(groups), 0.75))[0] + 1e-7), rel=1e-6)
        held += x.tolist()
        if vectors is not None:
            heads += vectors.tolist()


def test_feedback(spark):
    """Scores, thresholds and choices of a batch by batch run."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(480, 2)) @ np.array([[3.0, 1.0], [1.0, 1.0]])
    x[300:330] += rng.normal(size=(30, 2)) * 6  # many of these must not be learnt
    rows = [(i, i // 12, float(a), float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "seq long, batch_id long, a double, b double")
    out = {r.seq: r for r in P.feedback_scores(df, ["a", "b"], P.Reconstruction(2, 1), queue=120, warmup=10, chunk_batches=7).collect()}
    held, queue, refused = np.zeros((0, 2)), deque(maxlen=120), 0
    for b in range(40):
        own = x[b * 12 : b * 12 + 12]
        score = errors(held, own, 1) if len(held) else np.full(12, np.nan)
        threshold = float(np.quantile(queue, 0.99)) if b >= 10 else -1.0
        trains = np.ones(12, bool) if b < 10 else score < 2 * threshold
        if b >= 8:
            queue.extend(score[trains])
        held = np.concatenate((held, own[trains]))
        refused += (~trains).sum()
        for j in range(12):
            r = out[b * 12 + j]
            assert r.trained == trains[j] and r.threshold == pytest.approx(threshold)
            assert r.score is None if np.isnan(score[j]) else r.score == pytest.approx(score[j])
    assert refused > 5


def test_one_class(spark):
    rows = data(160, 3)
    df, names = frame(spark, rows, 3)
    got = {r.seq: r.score for r in P.one_class_stream(df, names, group_batches=4, steps=2).collect()}
    w, rho, step = np.zeros(3), 1.0, 0
    assert len(got) == len(rows)
    for g in sorted({r[1] // 4 for r in rows}):
        own = [(i, x) for i, b, x in rows if b // 4 == g]
        for i, x in own:
            assert got[i] == (None if g == 0 or None in x else pytest.approx(float(np.dot(w, x) - rho)))
        x = np.array([x for _, x in own if None not in x])
        for _ in range(2):
            step += 1
            inside = x @ w < rho
            pull, share = x[inside].sum(axis=0) / len(x), inside.mean()
            w, rho = w - 0.5 / np.sqrt(step) * (0.05 * w - pull), rho - 0.5 / np.sqrt(step) * (share - 0.05)

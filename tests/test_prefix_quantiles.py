"""Quantiles of all earlier batches against plain loops, in one part and in many."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import scale
from tidewire.operators.scale import batch_state, earlier_batches, kth_of_prefixes


def test_kth_of_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, m = int(rng.integers(1, 60)), int(rng.integers(0, 8))
        values, batches = rng.integers(0, 9, n).astype(float), rng.integers(0, 6, n)
        fixed, weights = rng.integers(0, 12, m).astype(float), rng.integers(1, 4, m)
        asked = []
        for b in range(7):
            for own in (False, True):
                held = sorted([*values[batches <= b if own else batches < b], *np.repeat(fixed, weights)])
                asked += [(b, own, k, held[k]) for k in range(len(held))]
        b, own, k, wanted = (np.array(x) for x in zip(*asked, strict=True)) if asked else ([],) * 4
        assert list(kth_of_prefixes(values, batches, fixed, weights, b, own, k)) == list(wanted)


@pytest.mark.parametrize(("part_rows", "queries"), [(4_000_000, 1_000_000), (150, 9)])
@pytest.mark.parametrize("saved", [False, True])
def test_earlier_batches(spark, monkeypatch, part_rows, queries, saved):
    monkeypatch.setattr(scale, "PART_ROWS", part_rows)
    monkeypatch.setattr(scale, "PIECE_QUERIES", queries)
    rng = random.Random(3)
    # A frequent value, missing values, a stream that starts late, a batch without values.
    rows = [
        (s, b, None if rng.random() < 0.1 or (s == "x" and b == 2) else rng.choice((7.0, 7.0, rng.random() * 20)), float(rng.randrange(5)))
        for s in "xy" for b in range(6) for _ in range(rng.randrange(1, 60)) if s == "x" or b > 1
    ]
    df = spark.createDataFrame(rows, "file string, batch_id long, a double, b double")
    before = spark.createDataFrame([(float(i % 11), float(i % 3)) for i in range(90)], "a double, b double")
    out = earlier_batches(df, ["a", "b"], stream=["file"], initial=batch_state(before, ["a", "b"]) if saved else None).collect()
    held = [tuple(r) for r in before.collect()] if saved else []
    assert len(out) == len({(r[0], r[1]) for r in rows})
    for r in out:
        for i, f in enumerate("ab"):
            earlier = sorted([x[i] for x in held] + [x[2 + i] for x in rows if x[0] == r.file and x[1] < r.batch_id and x[2 + i] is not None])
            values = earlier or sorted(x[2 + i] for x in rows if x[0] == r.file and x[1] == r.batch_id and x[2 + i] is not None)
            wanted = [values[max(0, int(np.ceil(p * len(values))) - 1)] for p in (0.16, 0.5, 0.84)] if values else [None] * 3
            assert [r[f"{f}_q0"], r[f"{f}_q1"], r[f"{f}_q2"]] == wanted
            assert r[f"{f}_n"] == len(earlier)
            assert r[f"{f}_mean"] == (pytest.approx(sum(earlier) / len(earlier)) if earlier else None)


def test_part_is_bounded():
    """A full part: four tasks of an executor keep well below its Python memory."""
    rng = np.random.default_rng(2)
    n = scale.PART_ROWS
    values, batches = rng.random(n), np.arange(n) // 1024
    asked = np.repeat(np.unique(batches)[1:], 3)
    k = (np.tile([0.16, 0.5, 0.84], len(asked) // 3) * asked * 1024).astype("int64")
    tracemalloc.start()
    kth_of_prefixes(values, batches, np.empty(0), np.empty(0, np.int64), asked, np.zeros(len(asked), bool), k)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_rows_of_few_groups_are_dealt(spark):
    """Three groups do not mean three tasks."""
    df = spark.range(0, 60_000, 1, 4).selectExpr("id", "cast(id % 3 AS string) AS flag", "cast(id AS double) AS x")
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32"}
    usual = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        out = scale.reference_scale(df, df, ["x"], kind="minmax", group=["flag"])
        rows = out.withColumn("_task", F.spark_partition_id()).collect()
    finally:
        for key, value in usual.items():
            spark.conf.set(key, value)
    assert len(rows) == 60_000
    assert max(Counter(r["_task"] for r in rows).values()) < 15_000
    low, high = 599.97 + 0.0, 59_397.03  # 1 and 99 per cent of the numbers 0, 3, ... 59,997
    wanted = {r["id"]: (r["id"] - low) / (high - low) for r in rows if r["flag"] == "0"}
    assert all(r["x"] == pytest.approx(wanted[r["id"]], abs=1e-9) for r in rows if r["flag"] == "0")

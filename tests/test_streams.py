"""Streams: batches over several triggers, rows per trigger."""

import datetime
import random

import numpy as np

from tidewire.operators.evaluate import batch_metrics
from tidewire.streaming import live


def landed(spark, folder, rows, schema, cuts):
    for low, high in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        spark.createDataFrame(rows[low:high], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(folder)


def test_batches_span_triggers(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f, i // 10, i, rng.random(), 0.5) for i in range(97) for f in ("x", "y")]
    schema = "file string, batch_id long, seq long, score double, threshold double"
    stream = landed(spark, str(tmp_path / "in"), rows, schema, [7, 50, 51, 120, 166])
    query = live.metrics_to(stream, str(tmp_path / "out"), str(tmp_path / "state"), by=("file", "batch_id"))
    query.awaitTermination()
    got = live.close_metrics(spark, str(tmp_path / "out"), by=("file", "batch_id"))
    wanted = batch_metrics(spark.createDataFrame(rows, schema), by=("file", "batch_id"))
    assert got.count() == wanted.count() == 20
    assert got.select(*wanted.columns).exceptAll(wanted).isEmpty()


def test_every_trigger_has_a_row(spark, tmp_path):
    """More triggers than the progress reports that are kept."""
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        rows = [(i, 1.0) for i in range(24)]
        stream = landed(spark, str(tmp_path / "in"), rows, "seq long, v double", list(range(2, 24, 2)))
        run = lambda: live.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        times = live.process_times(spark, run, str(tmp_path / "times")).orderBy("batch_num").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert [(r.batch_num, r.rows) for r in times if r.rows] == [(i, 2) for i in range(12)]
    assert all(r.process_time > 0 for r in times)


def test_rows_of_a_key_at_once():
    rng = np.random.default_rng(2)
    rates = np.array([5.0, 1.0, 0.01])
    for trial in range(40):
        n = int(rng.integers(1, 60))
        t = np.sort(np.cumsum(rng.exponential(rng.choice([0.01, 1.0, 900.0]), n)))
        v = None if trial % 3 == 0 else rng.normal(5, 2, n)
        last, sums = (None, None) if trial % 2 else (float(t[0] + rng.choice([-2.0, 0.5])), np.abs(rng.normal(3, 1, (3, 3))))
        got, end = live.decayed_rows(t, v, last, sums, rates)
        for i, at in enumerate(t):
            if last is not None and sums[0, 2] * 2.0 ** (-0.01 * max(at - last, 0.0)) < 1e-3:
                last, sums = None, None
            x = (0.0 if last is None else at - last) if v is None else v[i]
            add = np.array([1.0, x, x * x])[:, None] * np.ones(3)
            sums = add if sums is None else sums * 2.0 ** (-rates * max(at - last, 0.0)) + add
            last = at if last is None else max(at, last)
            assert np.allclose(got[i], sums, rtol=1e-9, atol=1e-12), (trial, i)
        assert end == last


def test_many_keys_share_a_state(spark, tmp_path):
    """Keys over several triggers: few calls whatever the number of keys, each key as if it were alone, a missing value stays with its key."""
    rng = random.Random(4)
    times = sorted(rng.random() * 40 for _ in range(600))
    rows = [(i, f"k{rng.randrange(150)}", datetime.datetime.fromtimestamp(1e6 + t, datetime.UTC), float(i % 7)) for i, t in enumerate(times)]
    rows[30] = (*rows[30][:3], None)
    schema = "seq long, name string, ts timestamp, v double"
    for value in ("v", None):
        stream = landed(spark, str(tmp_path / f"in{value}"), rows, schema, [100, 350])
        calls = live.keyed_statistics(stream, "name", value, late="1 hour", rates=(1.0, 0.5), buckets=4)
        out = str(tmp_path / f"out{value}")
        query = live.run_to_table(calls, out, str(tmp_path / f"state{value}"))
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 4
        got = {r["seq"]: r for r in spark.read.parquet(out).collect()}
        assert sorted(got) == list(range(600))
        held = {}
        for seq, name, ts, v in rows:
            t = ts.timestamp()
            last, w, s = held.get(name, (None, 0.0, 0.0))
            fade = 0.0 if last is None or w * 2.0 ** (-0.5 * (t - last)) < 1e-3 else 2.0 ** (-0.5 * (t - last))
            x = (np.nan if v is None else v) if value else (t - last if fade else 0.0)
            w, s = w * fade + 1, (s * fade if fade else 0.0) + x
            held[name] = (t, w, s)
            row = [got[seq]["stat_0p5_weight"], got[seq]["stat_0p5_mean"]]
            row[1] = np.nan if row[1] is None else row[1]
            assert np.allclose(row, [w, s / w], rtol=1e-6, atol=1e-9, equal_nan=True), (seq, name, row, w, s / w)

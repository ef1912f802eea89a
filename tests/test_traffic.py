"""Decayed statistics against the literal row-by-row recurrence."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewire.functions.columns import decay_tag
from tidewire.operators import decay
from tidewire.operators import traffic as TR

RATES = (5.0, 1.0, 0.1)
SCHEMA = "seq long, t double, src string, dst string, v double"


class Stat:
    def __init__(self):
        self.last, self.sums = None, None

    def add(self, t, v):
        if v is None:
            v = 0.0 if self.last is None else t - self.last
        new = [[1.0, v, v * v] for _ in RATES]
        if self.sums is not None:
            for i, rate in enumerate(RATES):
                f = 2.0 ** (-rate * (t - self.last))
                new[i] = [a * f + b for a, b in zip(self.sums[i], new[i], strict=True)]
        self.sums, self.last = new, t

    def read(self, i):
        w, s, ss = self.sums[i]
        if w < 1e-3:
            return w, 0.0, 0.0
        return w, s / w, abs(ss / w - (s / w) ** 2)


def sequential(rows):
    stats, links, out = {}, {}, {}
    for seq, t, src, dst, v in rows:
        a, b = stats.setdefault(src, Stat()), stats.setdefault(dst, Stat())
        a.add(t, v)
        sent = [a.read(i) for i in range(len(RATES))]
        b.add(t, -v)
        link = links.get((src, dst))
        ends = [(a.read(i), b.read(i)) for i in range(len(RATES))]
        if link is None:
            link = [t, [0.0] * len(RATES)]
        else:
            link[1] = [
                r * 2.0 ** (-rate * (t - link[0])) + (v - x[1]) * (v - y[1])
                for r, rate, (x, y) in zip(link[1], RATES, ends, strict=True)
            ]
            link[0] = t
        links[src, dst] = link
        row = {}
        for i, rate in enumerate(RATES):
            tag = decay_tag(rate)
            (w1, m1, q1), (w2, m2, q2) = ends[i]
            cov = 0.0 if w1 + w2 < 2e-3 else link[1][i] / (w1 + w2)
            spread = math.sqrt(q1) * math.sqrt(q2)
            row |= {
                f"link_{tag}_weight": sent[i][0],
                f"link_{tag}_mean": sent[i][1],
                f"link_{tag}_std": math.sqrt(sent[i][2]),
                f"link_{tag}_magnitude": math.hypot(m1, m2),
                f"link_{tag}_radius": math.hypot(q1, q2),
                f"link_{tag}_covariance": cov,
                f"link_{tag}_pcc": 0.0 if spread < 2e-3 else cov / spread,
            }
        out[seq] = row
    return out


def sample(n, seed=1, keys=4):
    rng = random.Random(seed)
    t, rows = 0.0, []
    for i in range(n):
        t += rng.choice([0.01, 0.3, 1.0, 12.0])
        rows.append((i, t, f"k{rng.randrange(keys)}", f"k{rng.randrange(keys)}", float(rng.randrange(1, 90))))
    return rows


@pytest.mark.parametrize("options", [{}, {"bits": 8, "carry_buckets": 6}, {"bits": 16, "carry_buckets": 4, "chunk_rows": 7}])
def test_link_statistics(spark, options):
    rows = sample(160)
    wanted = sequential(rows)
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, SCHEMA).repartition(5)
    found = TR.link_statistics(df, "src", "dst", "v", rates=RATES, **options).collect()
    assert len(found) == len(rows)
    for row in found:
        for name, value in wanted[row["seq"]].items():
            assert row[name] == pytest.approx(value, rel=1e-6, abs=2e-4), (row["seq"], name)


@pytest.mark.parametrize("options", [{}, {"bits": 8, "carry_buckets": 6, "chunk_rows": 5}])
def test_gap_statistics(spark, options):
    rows = sample(120)
    stats, wanted = {}, {}
    for seq, t, src, _, _ in rows:
        stat = stats.setdefault(src, Stat())
        stat.add(t, None)
        wanted[seq] = [stat.read(i)[:2] for i in range(len(RATES))]
    df = spark.createDataFrame(rows, SCHEMA)
    for row in TR.keyed_statistics(df, "src", None, rates=RATES, **options).collect():
        for i, rate in enumerate(RATES):
            tag = decay_tag(rate)
            assert row[f"stat_{tag}_weight"] == pytest.approx(wanted[row["seq"]][i][0], rel=1e-9)
            assert row[f"stat_{tag}_mean"] == pytest.approx(wanted[row["seq"]][i][1], rel=1e-7, abs=1e-9)


def test_three_packets_by_hand(spark):
    df = spark.createDataFrame([(0, 0.0, "a", "b", 8.0), (1, 1.0, "a", "b", 4.0), (2, 3.0, "a", "b", 2.0)], SCHEMA)
    rows = TR.keyed_statistics(df, "src", "v", rates=(1.0,)).orderBy("seq").collect()
    assert [r["stat_1_weight"] for r in rows] == pytest.approx([1.0, 1.5, 1.375])
    assert [r["stat_1_mean"] for r in rows] == pytest.approx([8.0, 8 / 1.5, 4 / 1.375])
    assert rows[0]["stat_1_std"] == 0.0


def test_idle_key_returns(spark):
    df = spark.createDataFrame([(0, 0.0, "a", "b", 8.0), (1, 5.0, "a", "b", 8.0), (2, 40.0, "a", "b", 2.0)], SCHEMA)
    for chunk in (1 << 20, 1):
        rows = TR.idle_sessions(df, ["src"], rates=(1.0,), chunk_rows=chunk).orderBy("seq").collect()
        assert [r["session"] for r in rows] == [0, 0, 1]
        assert rows[0]["expires_at"] == pytest.approx(math.log2(1000))


def test_peek_leaves_history_alone(spark):
    history = spark.createDataFrame([(0, 0.0, "a", "b", 8.0), (5, 4.0, "a", "b", 1.0)], SCHEMA)
    new = spark.createDataFrame([(3, 1.0, "a", "b", 4.0), (4, 1.0, "a", "b", 6.0)], SCHEMA)
    rows = TR.peek(history, new, "src", "v", rates=(1.0,)).orderBy("seq").collect()
    assert [r["stat_1_weight"] for r in rows] == pytest.approx([1.5, 1.5])
    assert [r["stat_1_mean"] for r in rows] == pytest.approx([8 / 1.5, 10 / 1.5])


def test_captures_share_packet_numbers(spark):
    schema = "file string, seq long, t double, protocol string, src_mac string, dst_mac string, src_ip string, dst_ip string, src_port string, dst_port string, packet_size double"
    rows = [(f, i, 0.5 * i, "TCP", "m1", "m2", "a", "b", "1", "2", size + i) for f, size in (("one", 10.0), ("two", 99.0)) for i in range(3)]
    both = spark.createDataFrame(rows, schema)
    for form in (TR.traffic_features, TR.link_features):
        found = sorted(map(tuple, form(both, (1.0,)).collect()))
        alone = [tuple(r) for f in ("one", "two") for r in form(both.where(f"file = '{f}'"), (1.0,)).collect()]
        assert len(found) == 6 and found == sorted(alone)
        assert found[0] != found[3]


def test_late_packets_cross_chunks(spark):
    rows = [(i, float(i), "a", "b", 1.0) for i in range(10)]
    late = [(9 - i, t, a, b, v) for i, t, a, b, v in rows]
    for chunk in (1 << 20, 3):
        found = TR.keyed_statistics(spark.createDataFrame(late, SCHEMA), "src", "v", rates=(1.0,), chunk_rows=chunk).collect()
        assert max(r["stat_1_weight"] for r in found) == pytest.approx(2 - 2.0**-9)


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """Adaptive execution leaves about one task per core; what each holds must not grow with the data."""
    rows = [(i, i / 7.0, f"m{i % 5}", f"u{i % 23}", f"u{i % 31}", float(i % 11)) for i in range(3_000)]
    df = spark.createDataFrame(rows, "seq long, t double, src_mac string, src_ip string, dst_ip string, packet_size double")
    usual = TR.keyed_statistics(df, TR.KEYS["ip_pair"], None).orderBy("seq").collect()
    monkeypatch.setattr(decay, "TASK_ROWS", 50)
    dealt = TR.keyed_statistics(df, TR.KEYS["ip_pair"], None)
    assert dealt.withColumn("_task", F.spark_partition_id()).select("_task").distinct().count() > 40
    assert [tuple(r) for r in dealt.orderBy("seq").collect()] == [tuple(r) for r in usual]
    pairs = [TR.Pair("channel", TR.KEYS["src_ip"], TR.KEYS["dst_ip"], "packet_size")]
    many = TR.statistics(df, [], pairs, rates=(1.0,)).orderBy("seq").collect()
    monkeypatch.setattr(decay, "TASK_ROWS", 1 << 17)
    assert [tuple(r) for r in many] == [tuple(r) for r in TR.statistics(df, [], pairs, rates=(1.0,)).orderBy("seq").collect()]

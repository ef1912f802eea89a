"""Statistics at the homes of the endpoints: disk, and values against the row-by-row recurrence."""

import math
import random

import pytest

from tests.test_traffic import Stat
from tidewire.functions.columns import decay_tag
from tidewire.operators import traffic as TR
from tidewire.operators.index import row_index

RATES = (5.0, 1.0, 0.1)
PACKETS = "file string, seq long, t double, src_mac string, dst_mac string, src_ip string, dst_ip string, src_port string, dst_port string, packet_size double"


def files_of(spark) -> int:
    """Bytes of the session's shuffle files."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()))


def test_statistics_take_little_disk(spark):
    """The result has 800 bytes a packet; with a shuffle per statistic the shuffles took more than twice that."""
    rng = random.Random(5)
    rows = [("f", i, i / 1e3, f"m{rng.randrange(20)}", "m1", f"u{rng.randrange(300)}", f"u{rng.randrange(50)}", "1", str(rng.randrange(9)), rng.random()) for i in range(20_000)]
    packets = spark.createDataFrame(rows, PACKETS)
    before = files_of(spark)
    TR.traffic_features(packets, stream=()).write.format("noop").mode("overwrite").save()
    assert files_of(spark) - before < 500 * len(rows)


def packets_with_gaps(n):
    """Packets to oneself, missing endpoints, ports and sizes, equal times, late rows and an address with most packets."""
    rng = random.Random(11)
    ips, ports, rows = ["a", "b", "c", "d", None], ["1", "2", None], []
    for file in ("one", "two"):
        t = 0.0
        for i in range(n):
            t += rng.choice([0.0, 0.01, 0.3, 12.0, 90.0])
            src, dst = rng.choice([*ips, "a", "a", "a"]), rng.choice([*ips, "b"])
            rows.append((file, i, t, rng.choice(["m1", "m2"]), "m3", src, dst, rng.choice(ports), rng.choice(ports), rng.choice([None, *map(float, range(1, 90))])))
    rng.shuffle(rows)
    return rows


class Sizes(Stat):
    """As Stat, where missing sizes count as packets only."""

    known = False

    def put(self, t, v, sign=1.0):
        self.add(t, 0.0 if v is None else sign * v)
        self.known |= v is not None

    def all(self, i):
        w, m, q = self.read(i)
        return (w, m, 0.0 if q <= 1e-12 * self.sums[i][2] / w else q) if self.known else (w, None, None)


def recurrence(rows):
    """Keys are tuples, so missing parts make keys of their own."""
    out, stats, links = {}, {}, {}
    for file, seq, t, mac, _, src, dst, sport, dport, v in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        found = {}

        def show(name, stat, i):
            w, m, q = stat.all(i)
            tag = decay_tag(RATES[i])
            found.update({f"{name}_{tag}_weight": w, f"{name}_{tag}_mean": m, f"{name}_{tag}_std": None if q is None else math.sqrt(q)})

        def stat(*key):
            return stats.setdefault((file, *key), Sizes())

        one, gap = stat("mac_ip", mac, src), stat("pair", src, dst)
        one.put(t, v)
        gap.add(t, None)
        gap.known = True
        for i in range(len(RATES)):
            show("src_mac_ip", one, i)
            show("jitter", gap, i)
        for name, near, far in (("channel", (src,), (dst,)), ("socket", (src, sport), (dst, dport))):
            a, b = stat(name, *near), stat(name, *far)
            a.put(t, v)
            for i in range(len(RATES)):
                show(name, a, i)
            b.put(t, v, -1.0)
            link = links.get((file, name, near, far))
            last, sums = link or (t, [0.0] * len(RATES))
            now = []
            for i, rate in enumerate(RATES):
                (w1, m1, q1), (w2, m2, q2) = a.all(i), b.all(i)
                r = 0.0 if v is None or link is None else (v - m1) * (v - m2)
                now.append(sums[i] * 2.0 ** (-rate * (t - last)) + r)
                cov = now[i] / (w1 + w2)
                both = m1 is not None and m2 is not None
                spread = math.sqrt(q1) * math.sqrt(q2) if both else None
                tag = decay_tag(rate)
                found |= {
                    f"{name}_{tag}_magnitude": math.hypot(m1, m2) if both else None,
                    f"{name}_{tag}_radius": math.hypot(q1, q2) if both else None,
                    f"{name}_{tag}_covariance": cov,
                    f"{name}_{tag}_pcc": None if not both else 0.0 if spread < 2e-3 else cov / spread,
                }
            links[file, name, near, far] = t, now
        out[file, seq] = found
    return out


@pytest.mark.parametrize("chunk_rows", [1 << 18, 9])
def test_features_at_homes(spark, chunk_rows):
    """Also where every home is cut into blocks."""
    rows = packets_with_gaps(120)
    wanted = recurrence(rows)
    found = TR.traffic_features(spark.createDataFrame(rows, PACKETS).repartition(3), RATES, chunk_rows=chunk_rows).collect()
    assert len(found) == len(rows)
    for row in found:
        for name, value in wanted[row["file"], row["seq"]].items():
            assert row[name] == (None if value is None else pytest.approx(value, rel=1e-6, abs=2e-4)), (row["file"], row["seq"], name)


def test_keys_across_homes_are_one_key(spark):
    """'a' to 'b_c' and 'a_b' to 'c' have the same key, as in the SQL."""
    rows = [("f", 0, 0.0, "m", "m", "a", "b_c", "1", "1", 5.0), ("f", 1, 1.0, "m", "m", "a_b", "c", "1", "1", 5.0)]
    found = TR.traffic_features(spark.createDataFrame(rows, PACKETS), (1.0,)).orderBy("seq").collect()
    assert [r["jitter_1_weight"] for r in found] == pytest.approx([1.0, 1.5])


def test_no_packets(spark):
    assert TR.traffic_features(spark.createDataFrame([], PACKETS), (1.0,)).collect() == []


def test_stored_numbers(spark):
    rows = [("one" if i % 3 else "two", i * 7 % 50, i) for i in range(50)]
    df = spark.createDataFrame(rows, "file string, t long, v long").repartition(6)
    for stream in ([], ["file"]):
        found = [row_index(df, ["t"], stream=stream, stored=stored).collect() for stored in (False, True)]
        assert sorted(found[0]) == sorted(found[1])

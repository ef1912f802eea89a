"""Captures, documents and summaries."""

import struct

from tidewire.operators import evaluate as E
from tidewire.operators.meta import traffic_records
from tidewire.plans.intake_queries import capture_packets
from tidewire.sources import captures as CA
from tidewire.sources import tables as ST


def frame(kind: str, i: int) -> bytes:
    eth = bytes([2, 0, 0, 0, 0, 1]) + bytes([2, 0, 0, 0, 0, i % 9])
    src, dst = bytes([10, 0, 0, i % 200]), bytes([10, 0, 1, 7])
    if kind == "arp":
        return eth + b"\x08\x06" + struct.pack(">HHBBH", 1, 0x800, 6, 4, 1) + eth[6:] + src + eth[:6] + dst
    proto = {"tcp": 6, "udp": 17, "icmp": 1}[kind]
    head = struct.pack(">BBHHHBBH", 0x45, 0, 40, 0, 0, 64, proto, 0) + src + dst
    return eth + b"\x08\x00" + head + struct.pack(">HH", 1000 + i, 80) + bytes(12)


def frames(n):
    return [frame(["tcp", "udp", "icmp", "arp"][i % 4], i) for i in range(n)] + [bytes(12) + b"\x88\xcc" + bytes(30)]


def write_pcap(path, data):
    with open(path, "wb") as out:
        out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
        for i, raw in enumerate(data):
            out.write(struct.pack("<IIII", 1_700_000_000 + i, 500_000, len(raw), len(raw)) + raw)


def write_pcapng(path, data):
    def block(kind, body):
        body += bytes(-len(body) % 4)
        size = len(body) + 12
        return struct.pack("<II", kind, size) + body + struct.pack("<I", size)

    with open(path, "wb") as out:
        out.write(block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)))
        out.write(block(1, struct.pack("<HHI", 1, 0, 65535)))
        for i, raw in enumerate(data):
            micros = (1_700_000_000 + i) * 1_000_000 + 500_000
            out.write(block(6, struct.pack("<IIIII", 0, micros >> 32, micros & 0xFFFFFFFF, len(raw), len(raw)) + raw))


def test_captures(spark, tmp_path):
    data = frames(200)
    write_pcap(tmp_path / "benign_a.pcap", data)
    write_pcapng(tmp_path / "attack_b.pcapng", data)
    whole = CA.read_captures(spark, str(tmp_path))
    split = CA.read_captures(spark, str(tmp_path), split_bytes=1500)
    assert split.rdd.getNumPartitions() > 3
    assert whole.count() == split.count() == 2 * len(data)
    assert whole.exceptAll(split).count() == 0
    for size in (1500, 8 << 20):
        stored = CA.stored_captures(spark, str(tmp_path), slice_bytes=size)
        assert stored.count() == whole.count() and stored.exceptAll(whole).count() == 0
    CA.write_captures(whole.where("file = 'benign_a' AND (has_ip OR has_arp)"), str(tmp_path / "again"))
    again, fields = CA.read_captures(spark, str(tmp_path / "again"), split_bytes=900), [n for n in CA.NAMES if n not in ("seq", "file")]
    assert again.count() == 200
    assert again.select(*fields).exceptAll(whole.where("file = 'benign_a'").select(*fields)).count() == 0
    rows = traffic_records(split, carry=["file"]).orderBy("file", "t").collect()
    assert len(rows) == 400
    first = [r for r in rows if r["file"] == "benign_a"][:4]
    assert [r["protocol"] for r in first] == ["TCP", "UDP", "ICMP", "ARP"]
    assert (first[0]["src_port"], first[0]["dst_port"]) == ("1000", "80")
    assert (first[2]["src_port"], first[3]["src_ip"]) == ("icmp", "10.0.0.3")
    assert first[0]["t"] == 1_700_000_000.5


def test_splits_lose_nothing(spark, tmp_path):
    records = [(1_700_000_000 + i + (i > 185) * 200_000, raw, len(raw)) for i, raw in enumerate(frames(200))]
    records[60] = (records[60][0], frame("tcp", 60) + bytes(300_000), 300_054)
    records[90] = (records[90][0], b"", 0)
    # A long pause, a long and an empty record, then a truncated last one.
    with open(tmp_path / "benign_a.pcap", "wb") as out:
        out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
        for seconds, raw, length in records:
            out.write(struct.pack("<IIII", seconds, 0, len(raw), length) + raw)
        out.write(struct.pack("<IIII", records[-1][0], 0, 500, 500) + bytes(40))
    whole = CA.read_captures(spark, str(tmp_path))
    assert whole.count() == 202
    for size in (700, 1500, 6000):
        split = CA.read_captures(spark, str(tmp_path), split_bytes=size)
        assert split.rdd.getNumPartitions() > 3 and split.count() == 202 and whole.exceptAll(split).isEmpty()
    # Read without the first pass of read_captures.
    assert spark.read.format("capture").option("splitBytes", "1500").load(str(tmp_path)).exceptAll(whole).isEmpty()
    assert CA.split_points(str(tmp_path / "benign_a.pcap"), 1500)[-1] == (tmp_path / "benign_a.pcap").stat().st_size


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_pcap(tmp_path / "in" / "benign_a.pcap", frames(20))
    CA.ingest_captures(spark, str(tmp_path / "in"), str(tmp_path / "out"), dataset="demo")
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.count() == 20
    assert stored.select("dataset", "file").distinct().collect() == [("demo", "benign_a")]


def test_graph_documents_split_and_join(spark, tmp_path):
    nodes = spark.createDataFrame([(1, f"n{i}", i, float(i)) for i in range(30)], "snapshot_id long, node string, count long, size double")
    edges = spark.createDataFrame([(1, f"n{i}", f"n{(i * 7) % 30}", 1, 2.0) for i in range(30)], "snapshot_id long, src string, dst string, count long, size double")
    docs = ST.graph_documents(nodes, edges, parts=4)
    assert docs.count() > 1
    ST.write_graphs(docs, str(tmp_path / "g"))
    back_nodes, back_edges = ST.read_graphs(spark, str(tmp_path / "g"))
    assert back_edges.select(edges.columns).exceptAll(edges).count() == 0
    assert back_nodes.select(nodes.columns).exceptAll(nodes).count() == 0 and back_nodes.count() == 30


def test_dataset_files(spark):
    files = ST.dataset_files(spark)
    assert files.where("dataset = 'UQ-IoT-IDS'").count() == 49
    assert files.where("ord = 0 AND state = 'new' AND file LIKE 'benign%'").count() == 2


def test_metrics_of_missing_scores(spark):
    rows = [(0, None, 1.0), (0, None, 1.0), (1, 2.0, 1.0), (1, None, 1.0), (1, 1.0, 1.0), (1, 4.0, 1.0)]
    found = E.batch_metrics(spark.createDataFrame(rows, "batch_id int, score double, threshold double")).orderBy("batch_id").collect()
    assert (found[0]["detection_rate"], found[0]["batch_size"], found[0]["median_score"]) == (0.0, 0, 0.0)
    assert (found[1]["detection_rate"], found[1]["pos_count"], found[1]["median_score"]) == (0.5, 2, 2.0)


def test_average_precision_with_ties(spark):
    rows = [("x", 0.9, 1), ("x", 0.8, 0), ("x", 0.8, 1), ("x", 0.1, 1)]
    found = E.average_precision(spark.createDataFrame(rows, "g string, score double, label int"), by=["g"]).first()
    assert abs(found["ap"] - (1 / 3 * 1 + 1 / 3 * (2 / 3) + 1 / 3 * (3 / 4))) < 1e-12


def test_unknown_file_is_an_error(spark):
    df = spark.createDataFrame([("other", 1, 2)], "file string, pos_count long, batch_size long")
    try:
        E.file_accuracy(df).collect()
    except Exception as error:  # noqa: BLE001
        assert "unknown file type" in str(error)
    else:
        raise AssertionError("no error")


def test_capture_of_many_hosts(spark, tmp_path):
    """Hosts above 65,535 keep their numbers."""
    users = [3, 65_535, 65_536, 90_001, 9_000_000, 1_500_000_003]
    kinds = ["click", "view", "purchase", "error", "signup", "click"]
    rows = [(i, user, kind, float(i), '{"k": 7}') for i, (user, kind) in enumerate(zip(users, kinds, strict=True))]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    events.selectExpr("*", "cast(timestamp_micros(1700000000000000 + event_id) AS timestamp_ntz) AS ts").write.parquet(str(tmp_path / "events.parquet"))
    found = {r["micros"] - 1_700_000_000_000_000: r for r in capture_packets(spark, str(tmp_path)).collect()}
    assert [found[i]["src_ip"] for i in range(6)] == [f"10.0.{u // 256}.{u % 256}" for u in users]
    assert {r["dst_ip"] for r in found.values()} == {"10.1.0.7"}
    assert [found[i]["file"] for i in range(6)] == [("attack_" if u % 4 else "benign_") + str(u % 4) for u in users]

"""Packet captures as a Spark data source: decoded headers of pcap and pcapng files.

In a mounted folder (``read_captures``) a classic pcap file is split into byte ranges, so one large capture is read by many tasks;
a first pass hops over the 16-byte record headers, one task per file, and every range starts at a record it met. A pcapng
file is one task. From any path that Spark reads (``stored_captures``) one task per file passes its bytes on in slices of
whole records, and the slices are decoded by all tasks. Rows carry the byte offset of their record as ``seq``: unique and in
capture order within the file. ``write_captures`` is the way back.
"""

from __future__ import annotations

import io
import json
import os
import struct
import uuid
from collections.abc import Iterator
from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tidewire.operators.meta import traffic_records

HEADERS = (
    "file string, seq long, t double, frame_len int, eth_src string, eth_dst string, has_ip boolean, has_ip6 boolean,"
    " has_arp boolean, has_tcp boolean, has_udp boolean, has_icmp boolean, ip_src string, ip_dst string,"
    " ip6_src string, ip6_dst string, arp_hwsrc string, arp_hwdst string, arp_psrc string, arp_pdst string,"
    " sport int, dport int"
)
NAMES = [part.split()[0] for part in HEADERS.split(",")]

# Fixed values of the capture and protocol formats.
PCAP_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1e-6),
    b"\xa1\xb2\xc3\xd4": (">", 1e-6),
    b"\x4d\x3c\xb2\xa1": ("<", 1e-9),
    b"\xa1\xb2\x3c\x4d": (">", 1e-9),
}
PCAPNG_SECTION = 0x0A0D0D0A
PCAPNG_INTERFACE = 1
PCAPNG_PACKET = 6
ETHERTYPE_IP, ETHERTYPE_ARP, ETHERTYPE_IP6 = 0x0800, 0x0806, 0x86DD
VLAN_TYPES = (0x8100, 0x88A8)
PROTO_ICMP, PROTO_TCP, PROTO_UDP = 1, 6, 17
IP6_EXTENSIONS = (0, 43, 60)
# End of fixed values.

SPLIT_BYTES = 128 << 20


def decode(frame: bytes) -> dict[str, object]:
    """Addresses, layers and ports of an Ethernet frame."""
    import ipaddress

    row: dict[str, object] = dict.fromkeys(NAMES)
    for flag in ("has_ip", "has_ip6", "has_arp", "has_tcp", "has_udp", "has_icmp"):
        row[flag] = False
    if len(frame) < 14:
        return row

    def mac(raw: bytes) -> str:
        return ":".join(f"{b:02x}" for b in raw)

    row["eth_dst"], row["eth_src"] = mac(frame[:6]), mac(frame[6:12])
    kind, at = struct.unpack_from(">H", frame, 12)[0], 14
    while kind in VLAN_TYPES and len(frame) >= at + 4:
        kind, at = struct.unpack_from(">H", frame, at + 2)[0], at + 4
    body = frame[at:]
    transport, payload = None, b""
    if kind == ETHERTYPE_ARP and len(body) >= 28:
        row["has_arp"] = True
        row["arp_hwsrc"], row["arp_hwdst"] = mac(body[8:14]), mac(body[18:24])
        row["arp_psrc"], row["arp_pdst"] = str(ipaddress.IPv4Address(body[14:18])), str(ipaddress.IPv4Address(body[24:28]))
    elif kind == ETHERTYPE_IP and len(body) >= 20:
        row["has_ip"] = True
        row["ip_src"], row["ip_dst"] = str(ipaddress.IPv4Address(body[12:16])), str(ipaddress.IPv4Address(body[16:20]))
        first_fragment = struct.unpack_from(">H", body, 6)[0] & 0x1FFF == 0
        if first_fragment:
            transport, payload = body[9], body[(body[0] & 15) * 4 :]
    elif kind == ETHERTYPE_IP6 and len(body) >= 40:
        row["has_ip6"] = True
        row["ip6_src"], row["ip6_dst"] = str(ipaddress.IPv6Address(body[8:24])), str(ipaddress.IPv6Address(body[24:40]))
        transport, payload = body[6], body[40:]
        while transport in IP6_EXTENSIONS and len(payload) >= 8:
            transport, payload = payload[0], payload[(payload[1] + 1) * 8 :]
    if transport in (PROTO_TCP, PROTO_UDP) and len(payload) >= 4:
        row["has_tcp" if transport == PROTO_TCP else "has_udp"] = True
        row["sport"], row["dport"] = struct.unpack_from(">HH", payload)
    elif transport == PROTO_ICMP and row["has_ip"]:
        row["has_icmp"] = True
    return row


def split_points(path: str, step: int) -> list[int]:
    """The first record offset at or after every ``step`` bytes, the end of the file last; only headers are read."""
    size, points = os.path.getsize(path), [0]
    with open(path, "rb") as handle:
        order, _ = PCAP_MAGIC[handle.read(24)[:4]]
        offset, goal = 24, step
        while offset < size:
            if offset >= goal:
                points.append(offset)
                goal = (offset // step + 1) * step
            handle.seek(offset + 8)
            head = handle.read(4)
            if len(head) < 4:
                break
            offset += 16 + struct.unpack(order + "I", head)[0]
    return [*points, size]


def _records(data: bytes, order: str, tick: float, base: int) -> Iterator[tuple[int, float, int, bytes]]:
    """The records of a slice that starts ``base`` bytes into its file."""
    at = 0
    while at + 16 <= len(data):
        seconds, fraction, kept, length = struct.unpack_from(order + "IIII", data, at)
        yield base + at, seconds + fraction * tick, length, data[at + 16 : at + 16 + kept]
        at += 16 + kept


def pcap_records(path: str, start: int, end: int) -> Iterator[tuple[int, float, int, bytes]]:
    """(offset, time, frame length, captured bytes) of the records in ``[start, end)``; a record starts at ``start``, or it is 0."""
    size = os.path.getsize(path)
    with open(path, "rb") as handle:
        order, tick = PCAP_MAGIC[handle.read(24)[:4]]
        offset = max(start, 24)
        while offset < min(end, size):
            handle.seek(offset)
            head = handle.read(16)
            if len(head) < 16:
                return
            seconds, fraction, kept, length = struct.unpack(order + "IIII", head)
            yield offset, seconds + fraction * tick, length, handle.read(kept)
            offset += 16 + kept


def pcapng_records(source: str | bytes) -> Iterator[tuple[int, float, int, bytes]]:
    ticks: list[float] = []
    order = "<"
    with io.BytesIO(source) if isinstance(source, bytes) else open(source, "rb") as handle:
        offset = 0
        while True:
            handle.seek(offset)
            head = handle.read(12)
            if len(head) < 12:
                return
            kind = struct.unpack(order + "I", head[:4])[0]
            if kind == PCAPNG_SECTION:
                order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
                ticks = []
            length = struct.unpack(order + "I", head[4:8])[0]
            if length < 12:
                return
            body = head[8:] + handle.read(length - 12)
            if kind == PCAPNG_INTERFACE:
                tick, at = 1e-6, 8
                while at + 4 <= len(body) - 4:
                    code, size = struct.unpack_from(order + "HH", body, at)
                    if code == 9 and size == 1:
                        value = body[at + 4]
                        tick = 2.0 ** -(value & 127) if value & 128 else 10.0**-value
                    if code == 0:
                        break
                    at += 4 + (size + 3) // 4 * 4
                ticks.append(tick)
            elif kind == PCAPNG_PACKET:
                face, high, low, kept, original = struct.unpack_from(order + "IIIII", body)
                yield offset, ((high << 32) | low) * ticks[face], original, body[20 : 20 + kept]
            offset += length


class CapturePart(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def capture_files(path: str) -> list[str]:
    files = []
    for folder, _, names in os.walk(path) if os.path.isdir(path) else [("", [], [path])]:
        files += [os.path.join(folder, n) for n in names if n.endswith((".pcap", ".pcapng"))]
    return sorted(files)


def divided(path: str, step: int) -> bool:
    return path.endswith(".pcap") and os.path.getsize(path) > step


class CaptureReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        # {file: split points}; files that it lacks are passed over here.
        self.points = json.loads(options.get("splitPoints", "{}"))

    def partitions(self):
        parts = []
        for path in capture_files(self.path):
            points = self.points.get(path) or (split_points(path, self.split) if divided(path, self.split) else [0, os.path.getsize(path)])
            parts += [CapturePart(path, start, end) for start, end in pairwise(points)]
        return parts

    def read(self, partition):
        name = os.path.splitext(os.path.basename(partition.path))[0]
        if partition.path.endswith(".pcap"):
            records = pcap_records(partition.path, partition.start, partition.end)
        else:
            records = pcapng_records(partition.path)
        yield from decoded_batches((name, record) for record in records)


def decoded_batches(records: Iterator[tuple[str, tuple[int, float, int, bytes]]]) -> Iterator:
    """Arrow batches of decoded headers from (file name, record)."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[t]) for n, t in (part.split() for part in HEADERS.split(","))])
    rows = []
    for name, (offset, seconds, length, frame) in records:
        rows.append({**decode(frame), "file": name, "seq": offset, "t": seconds, "frame_len": length})
        if len(rows) == 8192:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


class CaptureSource(DataSource):
    """``spark.read.format("capture").load(folder)``; the folder must be reachable from every executor."""

    @classmethod
    def name(cls):
        return "capture"

    def schema(self):
        return HEADERS

    def reader(self, schema):
        return CaptureReader(self.options)

    def writer(self, schema, overwrite):
        return CaptureWriter(self.options["path"])


class Written(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str]]):
        self.moves = moves  # (temporary, final) paths of one task


class CaptureWriter(DataSourceWriter):
    """One pcap file per value of ``file``; files of a task get their names when all tasks have ended."""

    def __init__(self, path: str):
        self.path = path
        os.makedirs(path, exist_ok=True)

    def write(self, iterator):
        moves: list[tuple[str, str]] = []
        handle, current = None, None
        for row in iterator:
            if row["file"] != current or handle is None:
                if handle:
                    handle.close()
                current = row["file"]
                moves.append((os.path.join(self.path, f".{current}-{uuid.uuid4().hex}"), os.path.join(self.path, f"{current}.pcap")))
                handle = open(moves[-1][0], "wb")
                handle.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262_144, 1))
            seconds, micros = divmod(row["micros"], 1_000_000)
            handle.write(struct.pack("<IIII", seconds, micros, len(row["frame"]), max(row["frame_len"], len(row["frame"]))) + bytes(row["frame"]))
        if handle:
            handle.close()
        return Written(moves)

    def commit(self, messages):
        for message in messages:
            for temporary, final in message.moves:
                os.replace(temporary, final)

    def abort(self, messages):
        for message in messages:
            for temporary, _ in message.moves if message else []:
                os.remove(temporary)


def read_captures(spark: SparkSession, path: str, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The packets of all captures below ``path``. Files above ``split_bytes`` are passed over first, one task per file."""
    spark.dataSource.register(CaptureSource)
    large = [f for f in capture_files(path) if divided(f, split_bytes)]
    points = dict(spark.sparkContext.parallelize(large, len(large)).map(lambda f: (f, split_points(f, split_bytes))).collect()) if large else {}
    return spark.read.format("capture").option("splitBytes", str(split_bytes)).option("splitPoints", json.dumps(points)).load(path)


SLICES = "name string, kind string, tick double, base long, data binary"


def stored_captures(spark: SparkSession, path: str, *, slice_bytes: int = 8 << 20) -> DataFrame:
    """The packets of all captures below ``path``, which may be any folder that Spark reads (each file at most 2 GB).

    A file is one row of bytes; its task hops over the record headers and passes on slices of whole records, which are dealt to
    all tasks and decoded there.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pcap,pcapng}").load(path)

    def sliced(batches):
        import pyarrow as pa

        schema = pa.schema([("name", pa.string()), ("kind", pa.string()), ("tick", pa.float64()), ("base", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            for place, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py()
                name, ending = os.path.splitext(os.path.basename(place.as_py()))
                order, tick = PCAP_MAGIC.get(data[:4], ("", 0.0)) if ending == ".pcap" else ("", 0.0)
                start = at = 24 if order else 0
                while order and at + 16 <= len(data):
                    at += 16 + struct.unpack_from(order + "I", data, at + 8)[0]
                    if at - start >= slice_bytes:
                        yield pa.RecordBatch.from_pylist([{"name": name, "kind": order, "tick": tick, "base": start, "data": data[start:at]}], schema=schema)
                        start = at
                if start < len(data):
                    yield pa.RecordBatch.from_pylist([{"name": name, "kind": order, "tick": tick, "base": start, "data": data[start:]}], schema=schema)

    def decoded(batches):
        def records():
            for batch in batches:
                for row in batch.to_pylist():
                    found = _records(row["data"], row["kind"], row["tick"], row["base"]) if row["kind"] else pcapng_records(row["data"])
                    yield from ((row["name"], record) for record in found)

        yield from decoded_batches(records())

    slices = files.select("path", "content").mapInArrow(sliced, SLICES)
    return slices.repartition("name", "base").mapInArrow(decoded, HEADERS)


def frame_of(row: dict[str, object]) -> bytes:
    """The headers of a packet as an Ethernet frame: what ``decode`` reads."""
    import ipaddress

    def mac(text: str) -> bytes:
        return bytes.fromhex(text.replace(":", ""))

    front = mac(row["eth_dst"]) + mac(row["eth_src"])
    if row["has_arp"]:
        ends = [mac(row["arp_hwsrc"]), ipaddress.IPv4Address(row["arp_psrc"]).packed, mac(row["arp_hwdst"]), ipaddress.IPv4Address(row["arp_pdst"]).packed]
        return front + struct.pack(">HHHBBH", ETHERTYPE_ARP, 1, ETHERTYPE_IP, 6, 4, 1) + b"".join(ends)
    if not row["has_ip"]:
        return front + struct.pack(">H", 0x88CC)
    kind = PROTO_TCP if row["has_tcp"] else PROTO_UDP if row["has_udp"] else PROTO_ICMP if row["has_icmp"] else 47
    body = struct.pack(">HH", row["sport"], row["dport"]) if row["has_tcp"] or row["has_udp"] else b""
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, kind, 0)
    ends = ipaddress.IPv4Address(row["ip_src"]).packed + ipaddress.IPv4Address(row["ip_dst"]).packed
    return front + struct.pack(">H", ETHERTYPE_IP) + head + ends + body


def write_captures(headers: DataFrame, path: str) -> None:
    """Write packets (columns of HEADERS; ``t`` in seconds, ``seq`` breaks ties) as one pcap file per ``file`` below a mounted folder.

    A capture file is a sequence, so one task writes it; give long captures a ``file`` per hour or so.
    """
    headers.sparkSession.dataSource.register(CaptureSource)

    def built(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            columns = [[r["file"] for r in rows], [r["seq"] for r in rows], [round(r["t"] * 1e6) for r in rows], [r["frame_len"] for r in rows], [frame_of(r) for r in rows]]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "seq", "micros", "frame_len", "frame"])

    frames = headers.mapInArrow(built, "file string, seq long, micros long, frame_len int, frame binary")
    frames.repartition("file").sortWithinPartitions("file", "micros", "seq").write.format("capture").mode("append").save(path)


def ingest_captures(spark: SparkSession, path: str, target: str, *, dataset: str) -> None:
    """Decode all captures below ``path`` into a Parquet table of traffic records, one folder per file."""
    headers = read_captures(spark, path)
    out = traffic_records(headers, carry=["file"]).withColumn("dataset", F.lit(dataset))
    out.write.mode("append").partitionBy("dataset", "file").parquet(target)

"""Queries of metadata, sources, sinks, streaming and operator chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import quantiles as Q
from tidewire.operators import evaluate as E
from tidewire.operators import graph as G
from tidewire.operators import index as IX
from tidewire.operators import meta as M
from tidewire.plans import chains as CH
from tidewire.plans.graph_queries import MULTILAYER, NODES, S, snapshots
from tidewire.plans.registry import query, r, round_stats, rounded
from tidewire.plans.score_queries import (
    _DOUBLES,
    _METRIC_COLS,
    _METRICS,
    _SCORES,
    SIZED,
    SIZES,
    before_sql,
    deviation_sql,
    file_metrics,
    prior_sql,
    scaled_sql,
    scores,
    sized,
)
from tidewire.plans.traffic_queries import keyed_sql
from tidewire.schema import MICROS_PER_DAY, PACKETS, packets, table
from tidewire.session import settle, staging_path
from tidewire.sources import captures as CA
from tidewire.sources import tables as ST
from tidewire.streaming import live as LV

# Decoded headers derived from the events: TCP, UDP, ICMP over IP, ARP, and signups as IPv6 or foreign frames.
_HEADERS = [
    "event_id AS seq",
    "cast(value AS int) AS frame_len",
    "concat('m', cast(user_id % 20 AS string)) AS eth_src",
    "concat('m', cast(k % 20 AS string)) AS eth_dst",
    "event_type IN ('click', 'view', 'purchase') AS has_ip",
    "event_type = 'signup' AND k < 50 AS has_ip6",
    "event_type = 'error' AS has_arp",
    "event_type = 'click' AS has_tcp",
    "event_type = 'view' AS has_udp",
    "event_type = 'purchase' AS has_icmp",
    "concat('u', cast(user_id AS string)) AS ip_src",
    "concat('u', cast(k AS string)) AS ip_dst",
    "concat('six', cast(user_id AS string)) AS ip6_src",
    "concat('six', cast(k AS string)) AS ip6_dst",
    "concat('hw', cast(user_id % 20 AS string)) AS arp_hwsrc",
    "concat('hw', cast(k % 20 AS string)) AS arp_hwdst",
    "concat('p', cast(user_id AS string)) AS arp_psrc",
    "concat('p', cast(k AS string)) AS arp_pdst",
    "cast(k AS int) AS sport",
    "cast(user_id % 100 AS int) AS dport",
]

# A handful of registered services (fixed values).
SERVICES = [
    (21, "tcp", "ftp"),
    (22, "tcp", "ssh"),
    (23, "tcp", "telnet"),
    (25, "tcp", "smtp"),
    (53, "tcp", "domain"),
    (53, "udp", "domain"),
    (67, "udp", "bootps"),
    (69, "udp", "tftp"),
    (80, "tcp", "http"),
]


def headers(spark, sf):
    events = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return events.selectExpr(f"unix_micros(cast(ts AS timestamp)) / {MICROS_PER_DAY!r}D AS t", *_HEADERS)


_RECORDS = """rec AS (SELECT event_id AS seq, epoch_us(ts) / 8.64e10 AS t, event_type,
    CASE event_type WHEN 'click' THEN 'TCP' WHEN 'view' THEN 'UDP' WHEN 'error' THEN 'ARP' WHEN 'purchase' THEN 'ICMP' ELSE 'Other' END AS protocol,
    CASE event_type WHEN 'click' THEN 'tcp' WHEN 'view' THEN 'udp' END AS transport,
    CASE WHEN event_type = 'error' THEN 'hw' ELSE 'm' END || (user_id % 20) AS src_mac,
    CASE WHEN event_type = 'error' THEN 'hw' ELSE 'm' END || (k % 20) AS dst_mac,
    CASE event_type WHEN 'error' THEN 'p' WHEN 'signup' THEN 'six' ELSE 'u' END || user_id AS src_ip,
    CASE event_type WHEN 'error' THEN 'p' WHEN 'signup' THEN 'six' ELSE 'u' END || k AS dst_ip,
    CASE WHEN event_type IN ('click', 'view') THEN CAST(k AS VARCHAR) WHEN event_type = 'error' THEN 'arp' WHEN event_type = 'purchase' THEN 'icmp' ELSE '' END AS src_port,
    CASE WHEN event_type IN ('click', 'view') THEN CAST(user_id % 100 AS VARCHAR) WHEN event_type = 'error' THEN 'arp' WHEN event_type = 'purchase' THEN 'icmp' ELSE '' END AS dst_port,
    trunc(value) AS packet_size
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
  WHERE event_type <> 'signup' OR k < 50)"""


@query("traffic_records", f"WITH {_RECORDS} SELECT * EXCLUDE (event_type, t), {r('t', 't')} FROM rec")
def traffic_records(spark, sf):
    return rounded(CH.metadata_extraction(headers(spark, sf)))


@query(
    "service_names",
    f"""WITH {_RECORDS}, sv(port, proto, name) AS (VALUES {", ".join(f"('{p}', '{t}', '{n}')" for p, t, n in SERVICES)})
      SELECT seq, src_port, dst_port, CASE WHEN transport IS NULL THEN protocol ELSE
        upper(coalesce(CASE WHEN coalesce(a.name, b.name) IN ('ssh', 'domain', 'http') THEN coalesce(a.name, b.name) END, transport)) END AS protocol
      FROM rec LEFT JOIN sv a ON a.port = src_port AND a.proto = transport LEFT JOIN sv b ON b.port = dst_port AND b.proto = transport""",
)
def service_names(spark, sf):
    services = spark.createDataFrame(SERVICES, "port int, proto string, name string")
    out = CH.metadata_extraction(headers(spark, sf), services, ["ssh", "domain", "http"])
    return out.select("seq", "src_port", "dst_port", "protocol")


@query("only_time", f"WITH {{packets}} SELECT {r('t', 't')} FROM packets")
def only_time(spark, sf):
    return rounded(M.only_time(packets(spark, sf)))


@query(
    "without_time",
    "WITH {packets} SELECT * EXCLUDE (t) FROM packets",
)
def without_time(spark, sf):
    return M.without_time(packets(spark, sf))


@query(
    "intake_counters",
    f"""WITH h AS (SELECT *, event_type <> 'signup' OR CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 AS kept FROM events)
      SELECT count(*) FILTER (NOT kept) AS skipped, count(*) FILTER (kept) AS processed,
        {r("max(epoch_us(ts) / 8.64e10) FILTER (kept)", "last_t")} FROM h""",
)
def intake_counters(spark, sf):
    return rounded(M.intake_counters(headers(spark, sf)))


@query(
    "layer_ids",
    """WITH {packets} SELECT seq, protocol, CASE protocol WHEN 'TCP' THEN 0 WHEN 'UDP' THEN 1 WHEN 'ICMP' THEN 2
      WHEN 'ARP' THEN 3 ELSE 4 END AS layer FROM packets""",
)
def layer_ids(spark, sf):
    return M.with_layer(packets(spark, sf).select("seq", "protocol"))


@query(
    "endpoint_keys",
    """WITH {packets}, l AS (SELECT *, CASE protocol WHEN 'TCP' THEN 0 WHEN 'UDP' THEN 1 WHEN 'ICMP' THEN 2 WHEN 'ARP' THEN 3 ELSE 4 END AS layer FROM packets)
      SELECT seq, file || '|' || src_mac || '_' || src_ip AS key_mac_ip, file || '|' || src_ip || '_' || dst_ip AS key_ip_pair,
        file || '|' || src_ip AS key_src_ip, file || '|' || dst_ip AS key_dst_ip,
        file || '|' || src_ip || '_' || src_port AS key_src_socket, file || '|' || dst_ip || '_' || dst_port AS key_dst_socket,
        file || '|' || src_mac || '/' || layer AS key_src_layer, file || '|' || dst_mac || '/' || layer AS key_dst_layer,
        file || '|' || src_ip || '->' || dst_ip AS key_channel FROM l""",
)
def endpoint_keys(spark, sf):
    keyed = M.with_keys(packets(spark, sf), ["file"])
    return keyed.select("seq", *[c for c in keyed.columns if c.startswith("key_")])


@query(
    "device_names",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_name AS device FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0""",
)
def device_names(spark, sf):
    devices = table(spark, sf, "supplier").where("s_acctbal > 0").selectExpr("s_suppkey AS mac", "s_name AS device")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return M.device_names(lines, devices, "l_suppkey")


@query(
    "row_index",
    """WITH {packets} SELECT seq, file, idx, idx // 1024 AS batch_id FROM
      (SELECT seq, file, row_number() OVER (PARTITION BY file ORDER BY t, seq) - 1 AS idx FROM packets)""",
)
def row_index(spark, sf):
    rows = packets(spark, sf).select("seq", "t", "file")
    return IX.batches(IX.row_index(rows, ["t", "seq"], stream=["file"])).drop("t")


@query("first_rows", "WITH {packets} SELECT seq, src_ip, dst_ip FROM packets ORDER BY t, seq LIMIT 1000")
def first_rows(spark, sf):
    return IX.first_rows(packets(spark, sf), ["t", "seq"], 1000).select("seq", "src_ip", "dst_ip")


@query(
    "stage_table",
    f"WITH {{packets}} SELECT * EXCLUDE (t), {r('t', 't')} FROM packets",
)
def stage_table(spark, sf):
    """Write a stage partitioned by file and read it back with its schema and batch numbers."""
    path = staging_path(spark, "stage")
    ST.write_stage(packets(spark, sf).drop("batch_id"), path)
    fields = [f for f in PACKETS.fields if f.name != "batch_id"]
    stage = ST.read_stage(spark, path, PACKETS.__class__(fields), index="seq")
    return rounded(stage)


@query(
    "stage_csv",
    """WITH {packets} SELECT seq, protocol, src_ip, dst_ip, src_port, dst_port, packet_size, file, seq // 1024 AS batch_id FROM packets""",
)
def stage_csv(spark, sf):
    path = staging_path(spark, "csv")
    columns = ["seq", "protocol", "src_ip", "dst_ip", "src_port", "dst_port", "packet_size"]
    ST.write_stage(packets(spark, sf).select(*columns, "file"), path, form="csv")
    schema = "seq long, protocol string, src_ip string, dst_ip string, src_port string, dst_port string, packet_size double, file string"
    return ST.read_stage(spark, path, schema, form="csv", index="seq")


def _graph_tables(spark, sf):
    rows = snapshots(spark, sf)
    return G.multilayer_nodes(rows), G.multilayer_edges(rows)


@query(
    "graph_documents",
    f"""WITH {{packets}}, {MULTILAYER}
      SELECT snapshot_id, src, dst, count(*) AS count, {r("sum(size)", "size", 4)} FROM e GROUP BY ALL""",
)
def graph_documents(spark, sf):
    """Write snapshots as JSON documents, read them back and list their links."""
    path = staging_path(spark, "graphs")
    ST.write_graphs(ST.graph_documents(*_graph_tables(spark, sf), parts=3), path)
    return rounded(ST.read_graphs(spark, path)[1], 4)


@query(
    "scored_documents",
    f"""WITH {{packets}}, ends AS ({NODES}),
      sc AS (SELECT {S}, max(packet_size) AS graph_as, CAST(100 AS DOUBLE) AS threshold FROM packets GROUP BY ALL)
      SELECT DISTINCT snapshot_id, node, graph_as, threshold FROM ends JOIN sc USING (snapshot_id)""",
)
def scored_documents(spark, sf):
    nodes, edges = _graph_tables(spark, sf)
    marks = snapshots(spark, sf).groupBy(G.SNAP).agg(F.max("packet_size").alias("score"), F.lit(100.0).alias("threshold"))
    path = staging_path(spark, "scored")
    ST.write_graphs(ST.scored_documents(nodes, edges, marks), path)
    docs = spark.read.json(path)
    return docs.select("snapshot_id", "graph.graph_as", "graph.threshold", F.explode("nodes.id").alias("node"))


@query(
    "snapshot_frame",
    f"""WITH {{packets}} SELECT DISTINCT {S}, src_mac AS src, dst_mac AS dst FROM packets
      WHERE floor(t) = (SELECT DISTINCT floor(t) AS d FROM packets ORDER BY d LIMIT 1 OFFSET 3)""",
)
def snapshot_frame(spark, sf):
    return ST.frame(G.layer_edges(snapshots(spark, sf), "physical"), 3)


@query("frame_count", "WITH {packets} SELECT count(DISTINCT floor(t)) AS frames FROM packets")
def frame_count(spark, sf):
    return ST.frame_count(snapshots(spark, sf))


@query(
    "file_order",
    """WITH {packets}, f AS (SELECT file, count(*) AS rows FROM packets GROUP BY ALL)
      SELECT file, rows, CASE WHEN file LIKE 'benign%' THEN 'new' ELSE 'loaded' END AS state,
        row_number() OVER (ORDER BY file NOT LIKE 'benign%', file) - 1 AS ord FROM f""",
)
def file_order(spark, sf):
    return ST.file_order(packets(spark, sf))


@query(
    "stored_metrics",
    f"""WITH {{packets}}, {_SCORES}, {_METRICS} SELECT file, batch_id, {r("t", "t")}, {", ".join(r(c, c) for c in _DOUBLES)},
      pos_count, batch_size FROM metrics""",
)
def stored_metrics(spark, sf):
    """Append metric rows file by file to one result table and read it."""
    path = staging_path(spark, "metrics")
    metrics = file_metrics(spark, sf)
    ST.append_metrics(metrics.where("file LIKE 'benign%'"), path)
    ST.append_metrics(metrics.where("file NOT LIKE 'benign%'"), path)
    return rounded(spark.read.parquet(path))


@query(
    "run_summaries",
    f"""WITH {{packets}}, {_SCORES}, {_METRICS} SELECT 'second' AS run_identifier, file,
      {r("CASE WHEN file LIKE 'benign%' THEN 1 - sum(pos_count) / sum(batch_size) ELSE sum(pos_count) / sum(batch_size) END", "accuracy")}
      FROM metrics GROUP BY file""",
)
def run_summaries(spark, sf):
    path = staging_path(spark, "runs")
    metrics = file_metrics(spark, sf)
    for run in ("first", "second"):
        ST.write_summary(
            E.column_summary(metrics),
            E.file_accuracy(metrics),
            path,
            {"dataset_name": "events", "pipeline_name": "sizes", "run_identifier": run},
        )
    return rounded(ST.read_summaries(spark, path, "run_identifier=sec")[1].select("run_identifier", "file", "accuracy"))


# Streams: the events land as files and are processed with the trigger "what is there".

_LATE_DAYS = 1


def landed(spark, sf):
    path = staging_path(spark, "landing")
    rows = packets(spark, sf).withColumn("ts", F.timestamp_micros(F.round(F.col("t") * MICROS_PER_DAY).cast("long")))
    rows.repartitionByRange(4, "seq").write.parquet(path)
    return LV.landing_packets(spark, path, rows.schema)


def collected(spark, stream):
    path = staging_path(spark, "stream")
    LV.run_to_table(stream, path, staging_path(spark, "progress"))
    return spark.read.schema(stream.schema).parquet(path)


# The last watermark is the latest time in whole milliseconds less the allowed lateness.
_CLOSED = "(SELECT epoch_ms(max(ts)) - 86400000 FROM events)"


@query(
    "stream_packets",
    "WITH {packets} SELECT seq, src_ip, dst_ip, packet_size FROM packets",
)
def stream_packets(spark, sf):
    return collected(spark, landed(spark, sf).select("seq", "src_ip", "dst_ip", "packet_size"))


@query(
    "stream_window_counts",
    f"""WITH w AS (SELECT date_trunc('hour', ts) AS window_start, count(*) AS frequency FROM events GROUP BY ALL)
      SELECT epoch_ms(window_start) AS window_ms, frequency FROM w WHERE epoch_ms(window_start) + 3600000 <= {_CLOSED}""",
)
def stream_window_counts(spark, sf):
    counts = LV.window_counts(landed(spark, sf), window="1 hour", late="1 day")
    return collected(spark, counts).select(F.unix_millis("window_start").alias("window_ms"), "frequency")


@query(
    "stream_layer_nodes",
    f"""WITH {{packets}}, p AS (SELECT date_trunc('hour', e.ts) AS w, packets.* FROM packets JOIN events e ON e.event_id = seq),
      ends AS (SELECT w, src_mac AS node, -1 AS sign, packet_size FROM p UNION ALL SELECT w, dst_mac, 1, packet_size FROM p)
      SELECT epoch_ms(w) AS window_ms, node, CAST(sum(sign) AS BIGINT) AS count, {r("sum(sign * packet_size)", "size", 4)}
      FROM ends WHERE epoch_ms(w) + 3600000 <= {_CLOSED} GROUP BY ALL""",
)
def stream_layer_nodes(spark, sf):
    nodes = LV.window_nodes(landed(spark, sf), src="src_mac", dst="dst_mac", window="1 hour", late="1 day")
    return rounded(
        collected(spark, nodes).select(F.unix_millis("window_start").alias("window_ms"), "node", "count", "size"), 4
    )


@query("stream_statistics", keyed_sql("src_mac || '_' || src_ip", "packet_size").replace(r("sums.t", "t", 6) + ", ", ""))
def stream_statistics(spark, sf):
    stats = LV.keyed_statistics(
        landed(spark, sf), "concat_ws('_', src_mac, src_ip)", "packet_size", late="1 day", unit_seconds=86_400.0
    )
    return round_stats(collected(spark, stats).drop("key", "ts"))


@query("stream_jitter", keyed_sql("src_ip || '_' || dst_ip", "gap").replace(r("sums.t", "t", 6) + ", ", ""))
def stream_jitter(spark, sf):
    stats = LV.keyed_statistics(
        landed(spark, sf), "concat_ws('_', src_ip, dst_ip)", None, late="1 day", unit_seconds=86_400.0
    )
    return round_stats(collected(spark, stats).drop("key", "ts"))


@query(
    "stream_metrics",
    f"""WITH {{packets}}, {_SCORES}, m AS (SELECT batch_id, {_METRIC_COLS} FROM scores GROUP BY batch_id)
      SELECT batch_id, {", ".join(r(c, c) for c in _DOUBLES)}, pos_count, batch_size FROM m""",
)
def stream_metrics(spark, sf):
    """Scores land in files that cut through batches and are read two files at a time."""
    path, rows_path = staging_path(spark, "metrics"), staging_path(spark, "landing")
    every = settle(scores(spark, sf))
    top = every.agg(F.max("seq")).first()[0] or 0
    for part in range(6):  # one after the other: a stream reads the oldest files first
        low, high = part * (top + 1) // 6, (part + 1) * (top + 1) // 6
        every.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(rows_path)
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", "2").parquet(rows_path)
    LV.metrics_to(stream, path, staging_path(spark, "progress")).awaitTermination()
    return rounded(LV.close_metrics(spark, path))


@query("process_times")
def process_times(spark, sf):
    stream = LV.window_counts(landed(spark, sf), window="1 hour", late="1 day")
    target, progress = staging_path(spark, "stream"), staging_path(spark, "progress")
    return LV.process_times(spark, lambda: LV.run_to_table(stream, target, progress), staging_path(spark, "times"))


# Captures: events are written as pcap files and read back, split.


def capture_headers(spark, sf):
    """Events as decoded packet headers with real addresses: an even second byte names sources, an odd one destinations.

    Hosts above 65,535 go on in the second and first byte; a capture holds one day.
    """
    events = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = {"tcp": "click", "udp": "view", "icmp": "purchase", "arp": "error"}
    flags = [f"event_type {'=' if n != 'ip' else '<>'} '{kind.get(n, 'error')}' AS has_{n}" for n in ("ip", "tcp", "udp", "icmp", "arp")]
    mac, ip = "concat('02:00:00:00:00:', lower(lpad(hex({0} % 20), 2, '0')))", "concat(10 + {0} div 8388608, '.', 2 * ({0} div 65536 % 128) + {1}, '.', {0} div 256 % 256, '.', {0} % 256)"
    ends = [f"{mac.format(e)} AS {n}" for n, e in (("eth_src", "user_id"), ("eth_dst", "k"), ("arp_hwsrc", "user_id"), ("arp_hwdst", "k"))]
    ends += [f"{ip.format(e, i)} AS {n}" for n, e, i in (("ip_src", "user_id", 0), ("ip_dst", "k", 1), ("arp_psrc", "user_id", 0), ("arp_pdst", "k", 1))]
    return events.selectExpr(
        "concat(CASE WHEN user_id % 4 = 0 THEN 'benign_' ELSE 'attack_' END, user_id % 4, '-', date_format(ts, 'yyyyMMdd')) AS file", "event_id AS seq",
        "unix_micros(cast(ts AS timestamp)) / 1e6D AS t", "cast(64 + floor(value) AS int) AS frame_len", *flags, "false AS has_ip6", *ends,
        "cast(1024 + user_id % 50000 AS int) AS sport", "k + 1 AS dport",
    )


@query(
    "capture_packets",
    """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
      SELECT CASE WHEN user_id % 4 = 0 THEN 'benign_' ELSE 'attack_' END || (user_id % 4) AS file, epoch_us(ts) AS micros,
        CASE event_type WHEN 'click' THEN 'TCP' WHEN 'view' THEN 'UDP' WHEN 'purchase' THEN 'ICMP' WHEN 'error' THEN 'ARP' ELSE 'Other' END AS protocol,
        '02:00:00:00:00:' || lpad(printf('%x', user_id % 20), 2, '0') AS src_mac, '02:00:00:00:00:' || lpad(printf('%x', k % 20), 2, '0') AS dst_mac,
        '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS src_ip, '10.1.' || (k // 256) || '.' || (k % 256) AS dst_ip,
        CASE event_type WHEN 'click' THEN CAST(1024 + user_id % 50000 AS VARCHAR) WHEN 'view' THEN CAST(1024 + user_id % 50000 AS VARCHAR)
          WHEN 'purchase' THEN 'icmp' WHEN 'error' THEN 'arp' ELSE '' END AS src_port,
        CASE event_type WHEN 'click' THEN CAST(k + 1 AS VARCHAR) WHEN 'view' THEN CAST(k + 1 AS VARCHAR)
          WHEN 'purchase' THEN 'icmp' WHEN 'error' THEN 'arp' ELSE '' END AS dst_port,
        CAST(64 + floor(value) AS DOUBLE) AS packet_size FROM e""",
)
def capture_packets(spark, sf):
    path = staging_path(spark, "captures").removeprefix("file:")
    CA.write_captures(capture_headers(spark, sf), path)
    records = M.traffic_records(CA.stored_captures(spark, path, slice_bytes=64 << 10), carry=["file"])
    host = "concat('10.', b[1] % 2, '.', ((b[0] - 10) * 128 + b[1] div 2) * 256 + b[2], '.', b[3])"
    ips = [F.expr(f"transform(array(cast(split({c}, '[.]') AS array<int>)), b -> {host})[0]").alias(c) for c in ("src_ip", "dst_ip")]
    return records.select(
        F.regexp_replace("file", "-[0-9]+$", "").alias("file"), F.round(F.col("t") * 1_000_000).cast("long").alias("micros"), "protocol", "src_mac", "dst_mac", *ips,
        "src_port", "dst_port", "packet_size"
    )


# Chains.


@query(
    "user_step",
    f"""WITH {{packets}}, x AS (SELECT batch_id, max(packet_size) AS top FROM packets GROUP BY ALL)
      SELECT seq, {r("packet_size / top", "share")} FROM packets JOIN x USING (batch_id)""",
)
def user_step(spark, sf):
    """Any DataFrame function as a step."""

    def share(df):
        top = df.groupBy("batch_id").agg(F.max("packet_size").alias("top"))
        return df.join(top, on="batch_id").select("seq", (F.col("packet_size") / F.col("top")).alias("share"))

    return rounded(packets(spark, sf).transform(share))


@query(
    "basic_detection",
    f"""WITH {{packets}}, {SIZED}, {prior_sql("sized", SIZES, own_first=False)},
      sc AS (SELECT seq, batch_id, {deviation_sql(SIZES)} AS score FROM sized LEFT JOIN prior USING (batch_id)),
      b AS (SELECT DISTINCT batch_id FROM sc),
      q AS (SELECT b.batch_id, quantile_cont(score, 0.99) AS q FROM b JOIN sc p
        ON p.seq < b.batch_id * 1024 AND p.seq >= b.batch_id * 1024 - 10000 GROUP BY ALL),
      scores AS (SELECT sc.*, CASE WHEN batch_id >= 2 THEN q ELSE -1 END AS threshold FROM sc LEFT JOIN q USING (batch_id)),
      metrics AS (SELECT batch_id, {_METRIC_COLS} FROM scores GROUP BY batch_id)
      SELECT batch_id, {", ".join(r(c, c) for c in _DOUBLES)}, pos_count, batch_size FROM metrics""",
)
def basic_detection(spark, sf):
    return rounded(CH.basic_detection(sized(spark, sf), SIZES, warmup=2))


@query(
    "scaled_detection",
    f"""WITH {{packets}}, {SIZED}, {prior_sql("sized", SIZES)},
      x AS (SELECT seq, batch_id, {scaled_sql("packet_size")} AS a, {scaled_sql("k")} AS b FROM sized JOIN prior USING (batch_id)),
      {before_sql("x", "a", "b")},
      sc AS (SELECT seq, batch_id, pow((a - ma) * vx + (b - mb) * vy, 2) / 2 AS score FROM x LEFT JOIN v USING (batch_id)),
      n AS (SELECT DISTINCT batch_id FROM sc),
      q AS (SELECT n.batch_id, quantile_cont(score, 0.99) AS q FROM n JOIN sc p
        ON p.seq < n.batch_id * 1024 AND p.seq >= n.batch_id * 1024 - 10000 GROUP BY ALL),
      scores AS (SELECT sc.*, CASE WHEN batch_id >= 2 THEN q ELSE -1 END AS threshold FROM sc LEFT JOIN q USING (batch_id)),
      metrics AS (SELECT batch_id, {_METRIC_COLS} FROM scores GROUP BY batch_id)
      SELECT batch_id, {", ".join(r(f"coalesce({c}, 0)", c) for c in _DOUBLES)},
        CASE WHEN median_score IS NULL THEN 0 ELSE pos_count END AS pos_count, CASE WHEN median_score IS NULL THEN 0 ELSE batch_size END AS batch_size FROM metrics""",
)
def scaled_detection(spark, sf):
    return rounded(CH.scaled_detection(sized(spark, sf), SIZES, latent=1, warmup=2))


@query("layered_detection")
def layered_detection(spark, sf):
    """Link statistics are one stage's table, detection the next stage's plan."""
    path = staging_path(spark, "links")
    links = CH.feature_extraction(packets(spark, sf), form="link")
    ST.write_stage(links, path, partition_by=["protocol"])
    stage = ST.read_stage(spark, path, links.schema, index="seq")
    return CH.layered_detection(stage, ["src_1_weight", "src_1_mean", "dst_1_weight", "link_1_magnitude"], warmup=2)


@query("multilayer_graph_detection")
def multilayer_graph_detection(spark, sf):
    nodes, edges = CH.graph_feature_extraction(snapshots(spark, sf))
    return CH.multilayer_graph_features(nodes, edges, rows_per_batch=4, warmup=2)


@query("graph_reconstruction")
def graph_reconstruction(spark, sf):
    nodes, edges = CH.graph_feature_extraction(snapshots(spark, sf))
    return CH.multilayer_graph_reconstruction(nodes, edges)


_FIT = """numbered AS (SELECT file, packet_size, k, row_number() OVER (PARTITION BY file ORDER BY t, seq) - 1 AS seq FROM sized),
    batched AS (SELECT *, seq // 1024 AS batch_id FROM numbered),
    att AS (SELECT * FROM batched WHERE file NOT LIKE 'benign%'),
    ben AS (SELECT * FROM batched WHERE file LIKE 'benign%')"""


def _prior_files(cols: str) -> str:
    return f"""ab AS (SELECT DISTINCT file, batch_id FROM att),
      hist AS (SELECT ab.file, ab.batch_id, h.packet_size, h.k FROM ab JOIN att h ON h.file = ab.file AND h.batch_id < ab.batch_id
        UNION ALL SELECT ab.file, ab.batch_id, b.packet_size, b.k FROM ab CROSS JOIN ben b),
      prior AS (SELECT file, batch_id, {cols} FROM hist GROUP BY ALL)"""


_Q = ", ".join(
    f"quantile_disc({f}, 0.16) AS {f}_q0, quantile_disc({f}, 0.84) AS {f}_q2, avg({f}) AS {f}_mean" for f in SIZES
)
_QB = ", ".join(
    f"quantile_disc(h.{f}, 0.16) AS {f}_q0, quantile_disc(h.{f}, 0.84) AS {f}_q2, avg(h.{f}) AS {f}_mean" for f in SIZES
)


@query(
    "saved_state_detection",
    f"""WITH {{packets}}, {SIZED}, {_FIT}, {_prior_files(_Q)},
      asc_ AS (SELECT file, seq, batch_id, {deviation_sql(SIZES)} AS score FROM att JOIN prior USING (file, batch_id)),
      bp AS (SELECT b.batch_id, {_QB} FROM (SELECT DISTINCT batch_id FROM ben) b JOIN ben h ON h.batch_id < b.batch_id GROUP BY ALL),
      bsc AS (SELECT seq, {deviation_sql(SIZES)} AS score FROM ben LEFT JOIN bp USING (batch_id)),
      hist2 AS (SELECT file, seq, score FROM asc_ UNION ALL
        SELECT f.file, -row_number() OVER (PARTITION BY f.file ORDER BY seq DESC), score FROM bsc, (SELECT DISTINCT file FROM att) f),
      th AS (SELECT a.file, a.batch_id, quantile_cont(h.score, 0.99) AS threshold FROM ab a JOIN hist2 h
        ON h.file = a.file AND h.seq < a.batch_id * 1024 AND h.seq >= a.batch_id * 1024 - 2000 GROUP BY ALL)
      SELECT file, seq, batch_id, {r("score", "score")}, {r("threshold", "threshold")} FROM asc_ JOIN th USING (file, batch_id)""",
)
def saved_state_detection(spark, sf):
    rows = IX.row_index(sized(spark, sf).withColumnRenamed("seq", "_at").drop("batch_id"), ["t", "_at"], stream=["file"], name="seq")
    rows = IX.batches(rows, "seq").drop("_at")
    state = staging_path(spark, "state")
    CH.fit_detector(rows.where("file LIKE 'benign%'"), SIZES, state, queue=2000)
    return rounded(CH.apply_detector(rows.where("file NOT LIKE 'benign%'"), SIZES, state, queue=2000))


@query(
    "reloaded_state_difference",
    f"""WITH {{packets}}, {SIZED} SELECT 'packet_size' AS feature, count(packet_size) AS rows, quantile_disc(packet_size, 0.16) AS q0,
        quantile_disc(packet_size, 0.5) AS q1, quantile_disc(packet_size, 0.84) AS q2 FROM sized
      UNION ALL SELECT 'k', count(k), quantile_disc(k, 0.16), quantile_disc(k, 0.5), quantile_disc(k, 0.84) FROM sized""",
)
def reloaded_state_difference(spark, sf):
    """State saved half way, read back and continued; SQL reads the same quantiles from one uninterrupted run."""
    rows = sized(spark, sf)
    path = staging_path(spark, "state")
    Q.quantile_state(rows.where("batch_id % 2 = 0"), SIZES).write.parquet(path)
    rest = Q.quantile_state(rows.where("batch_id % 2 = 1"), SIZES)
    return Q.state_quantiles(Q.merge_states(spark.read.parquet(path).unionByName(rest)), [0.16, 0.5, 0.84])

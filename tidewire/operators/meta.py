"""Packet metadata: from decoded header columns to traffic records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.traffic import KEYS, layer_id_sql

def traffic_records(headers: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Keep IP, IPv6 and ARP packets and choose endpoints by layer precedence.

    ARP overrides the hardware addresses, and where there is no port also the IPs; port labels become
    ``arp``/``icmp`` for packets without ports. A packet with no address at all takes its hardware addresses.
    ``transport`` is tcp, udp or null; ``carry`` columns pass through.
    """
    ported = "(has_tcp OR has_udp)"
    label = "CASE WHEN has_arp THEN 'arp' WHEN has_icmp THEN 'icmp' ELSE '' END"
    by_ip = "CASE WHEN has_ip THEN ip_{0} WHEN has_ip6 THEN ip6_{0} ELSE '' END"

    def ip(side: str) -> str:
        nothing = f"NOT {ported} AND NOT has_arp AND NOT has_icmp AND NOT has_ip AND NOT has_ip6"
        return (
            f"CASE WHEN NOT {ported} AND has_arp THEN arp_p{side} WHEN {nothing} THEN eth_{side}"
            f" ELSE {by_ip.format(side)} END"
        )

    return headers.where("has_ip OR has_ip6 OR has_arp").selectExpr(
        *carry,
        "seq",
        "t",
        "CASE WHEN has_tcp THEN 'TCP' WHEN has_udp THEN 'UDP' WHEN has_arp THEN 'ARP'"
        " WHEN has_icmp THEN 'ICMP' ELSE 'Other' END AS protocol",
        "CASE WHEN has_tcp THEN 'tcp' WHEN has_udp THEN 'udp' END AS transport",
        "CASE WHEN has_arp THEN arp_hwsrc ELSE eth_src END AS src_mac",
        "CASE WHEN has_arp THEN arp_hwdst ELSE eth_dst END AS dst_mac",
        f"{ip('src')} AS src_ip",
        f"{ip('dst')} AS dst_ip",
        f"CASE WHEN {ported} THEN cast(sport AS string) ELSE {label} END AS src_port",
        f"CASE WHEN {ported} THEN cast(dport AS string) ELSE {label} END AS dst_port",
        "cast(frame_len AS double) AS packet_size",
    )


def service_names(records: DataFrame, services: DataFrame, known: Sequence[str] = ()) -> DataFrame:
    """Replace ``protocol`` of TCP and UDP rows by the service of the source, else the destination port.

    ``services(port, proto, name)`` is the port table: one row per registered port and transport, at most
    2 x 65,536 short rows, which bounds the broadcast. Services outside ``known`` fall back to the transport.
    """
    table = services.select(F.col("port").cast("string").alias("_port"), F.col("proto").alias("_proto"), "name")

    def lookup(df: DataFrame, column: str, out: str) -> DataFrame:
        side = F.broadcast(table.withColumnRenamed("name", out))
        match = (F.col(column) == F.col("_port")) & (F.col("transport") == F.col("_proto"))
        return df.join(side, match, "left").drop("_port", "_proto")

    named = lookup(lookup(records, "src_port", "_by_src"), "dst_port", "_by_dst")
    service = F.coalesce("_by_src", "_by_dst", "transport")
    if known:
        service = F.when(service.isin(list(known)), service).otherwise(F.col("transport"))
    else:
        service = F.col("transport")
    return named.withColumn(
        "protocol", F.when(F.col("transport").isNotNull(), F.upper(service)).otherwise(F.col("protocol"))
    ).drop("_by_src", "_by_dst")


def only_time(df: DataFrame, time: str = "t") -> DataFrame:
    return df.select(time)


def without_time(df: DataFrame, time: str = "t") -> DataFrame:
    return df.drop(time)


def intake_counters(headers: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Rejected and accepted packets and the last accepted time."""
    kept = F.col("has_ip") | F.col("has_ip6") | F.col("has_arp")
    return headers.groupBy(*group).agg(
        F.count_if(~kept).alias("skipped"),
        F.count_if(kept).alias("processed"),
        F.max(F.when(kept, F.col("t"))).alias("last_t"),
    )


def with_layer(df: DataFrame, protocol: str = "protocol", ids: dict[str, int] | None = None) -> DataFrame:
    return df.selectExpr("*", f"{layer_id_sql(protocol, ids)} AS layer")


def with_keys(df: DataFrame, stream: Sequence[str] = ()) -> DataFrame:
    """The composite endpoint keys, prefixed by the stream columns."""
    prefix = "".join(f"cast({c} AS string), " for c in stream)
    texts = [f"concat_ws('|', {prefix}{sql}) AS key_{name}" for name, sql in KEYS.items()]
    layer = layer_id_sql()
    for side in ("src", "dst"):
        texts.append(f"concat_ws('|', {prefix}concat_ws('/', {side}_mac, cast({layer} AS string))) AS key_{side}_layer")
    texts.append(f"concat_ws('|', {prefix}concat({KEYS['src_ip']}, '->', {KEYS['dst_ip']})) AS key_channel")
    return df.selectExpr("*", *texts)


def device_names(df: DataFrame, devices: DataFrame, column: str = "src_mac") -> DataFrame:
    """Attach the device label of a hardware address (``devices(mac, device)``; unknown: null)."""
    side = devices.select(F.col("mac").alias(column), "device")
    return df.join(side, on=column, how="left")

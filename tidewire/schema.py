"""Schemas, fixed values and the packet view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.session import configure

# They must equal the published ones for equal results.
DECAY_RATES = (5.0, 3.0, 1.0, 0.1, 0.01)
WEIGHT_FLOOR = 1e-3
PAIR_FLOOR = 2e-3
BATCH_ROWS = 1024
QUEUE_ROWS = 10_000
WARMUP_BATCHES = 1000
WARMUP_SPLIT = 0.8
THRESHOLD_QUANTILE = 0.99
TOLERANCE = 2.0
PROTOCOL_IDS = {"TCP": 0, "UDP": 1, "ICMP": 2, "ARP": 3, "Other": 4}
SCALE_QUANTILES = (0.16, 0.5, 0.84)
SCALE_LIMIT = 1e6
CONCEPT_MIN_ROWS = 60
CONCEPT_MAX_ROWS = 3600
# End of fixed values.

PACKETS = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("t", T.DoubleType(), False),
        T.StructField("protocol", T.StringType()),
        T.StructField("src_mac", T.StringType()),
        T.StructField("dst_mac", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.StringType()),
        T.StructField("dst_port", T.StringType()),
        T.StructField("packet_size", T.DoubleType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("file", T.StringType()),
    ]
)

GRAPH_JSON = T.StructType(
    [
        T.StructField("graph", T.StructType([T.StructField("time_stamp", T.DoubleType())])),
        T.StructField("directed", T.BooleanType()),
        T.StructField("multigraph", T.BooleanType()),
        T.StructField(
            "nodes",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("layer", T.StringType()),
                        T.StructField("count", T.LongType()),
                        T.StructField("size", T.DoubleType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "links",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("source", T.StringType()),
                        T.StructField("target", T.StringType()),
                        T.StructField("count", T.LongType()),
                        T.StructField("size", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)

MICROS_PER_DAY = 8.64e10


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def epoch_micros(column: str | Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp (session zone is UTC)."""
    return F.unix_micros(F.col(column).cast("timestamp") if isinstance(column, str) else column.cast("timestamp"))


def packets_from_events(events: DataFrame) -> DataFrame:
    """Read an event table as packets: time in days, endpoints from the user and the property ``k``."""
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    protocol = (
        F.when(F.col("event_type") == "click", "TCP")
        .when(F.col("event_type") == "view", "UDP")
        .when(F.col("event_type") == "purchase", "ICMP")
        .when(F.col("event_type") == "error", "ARP")
        .otherwise("Other")
    )
    return events.select(
        F.col("event_id").alias("seq"),
        (epoch_micros("ts") / F.lit(MICROS_PER_DAY)).alias("t"),
        protocol.alias("protocol"),
        F.concat(F.lit("m"), (user % 20).cast("string")).alias("src_mac"),
        F.concat(F.lit("m"), (k % 20).cast("string")).alias("dst_mac"),
        F.concat(F.lit("u"), user.cast("string")).alias("src_ip"),
        F.concat(F.lit("u"), k.cast("string")).alias("dst_ip"),
        F.col("event_type").alias("src_port"),
        k.cast("string").alias("dst_port"),
        F.col("value").alias("packet_size"),
        F.floor(F.col("event_id") / F.lit(BATCH_ROWS)).alias("batch_id"),
        F.when(user % 4 == 0, F.lit("benign_0"))
        .otherwise(F.concat(F.lit("attack_"), (user % 4).cast("string")))
        .alias("file"),
    )


def packets(spark: SparkSession, folder: str) -> DataFrame:
    """The packet view of ``events`` in a data folder."""
    return packets_from_events(table(spark, folder, "events"))

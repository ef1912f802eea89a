"""Stage tables, graph documents, run summaries and the file list of a dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.operators.graph import SNAP
from tidewire.schema import BATCH_ROWS, GRAPH_JSON

# The registered captures of the two known datasets.
TEST_BENIGN = "benign_lenovo_bulb"
TEST_ATTACKS = ("malicious_ACK_Flooding", "malicious_Port_Scanning", "malicious_Service_Detection")
WEEK_BENIGN = "benign_samples/whole_week"
WEEK_DEVICES = (
    "Cam_1",
    "Google-Nest-Mini_1",
    "Lenovo_Bulb_1",
    "Raspberry_Pi_telnet",
    "Smart_Clock_1",
    "Smartphone_1",
    "Smartphone_2",
    "SmartTV",
)
WEEK_ATTACKS = (
    "ACK_Flooding",
    "ARP_Spoofing",
    "Port_Scanning",
    "Service_Detection",
    "SYN_Flooding",
    "UDP_Flooding",
)
# End of fixed values.


def write_stage(
    df: DataFrame, path: str, *, partition_by: Sequence[str] = ("dataset", "file"), form: str = "parquet", mode: str = "append"
) -> None:
    """Write a stage's output below ``path`` in folders by ``partition_by`` (Parquet with zstd, or CSV)."""
    writer = df.write.mode(mode).partitionBy(*[c for c in partition_by if c in df.columns])
    if form == "csv":
        writer.option("header", True).option("compression", "gzip").csv(path)
    else:
        writer.option("compression", "zstd").parquet(path)


def read_stage(
    spark: SparkSession, path: str, schema: T.StructType | str, *, form: str = "parquet", index: str | None = None
) -> DataFrame:
    """Read a stage's output with its explicit schema; ``index`` numbers the rows and gives ``batch_id``."""
    reader = spark.read.schema(schema)
    df = reader.option("header", True).csv(path) if form == "csv" else reader.parquet(path)
    return df.withColumn("batch_id", F.floor(F.col(index) / F.lit(BATCH_ROWS))) if index else df


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append metric rows to the result table."""
    metrics.write.mode("append").parquet(path)


def graph_documents(nodes: DataFrame, edges: DataFrame, *, time: DataFrame | None = None, parts: int = 1) -> DataFrame:
    """Snapshots as node-link documents.

    Every snapshot becomes ``parts`` documents with the same ``snapshot_id`` (by a hash of the item); a part without
    nodes or links is left out. Take more parts where snapshots are large; reading puts them together again.
    """
    node_fields = [F.col("node").alias("id"), *[F.col(c) for c in ("layer", "count", "size") if c in nodes.columns]]
    link_fields = [
        F.col("src").alias("source"), F.col("dst").alias("target"), *[F.col(c) for c in ("count", "size") if c in edges.columns]
    ]

    def packed_by(df: DataFrame, key: Sequence[str], fields, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*key), F.lit(parts)).alias("part")
        return df.groupBy(SNAP, part).agg(F.collect_list(F.struct(*fields)).alias(name))

    packed = packed_by(nodes, ["node"], node_fields, "nodes").join(
        packed_by(edges, ["src", "dst"], link_fields, "links"), on=[SNAP, "part"], how="full"
    )
    stamp = F.col(SNAP).cast("double")
    if time is not None:
        packed, stamp = packed.join(time, on=SNAP, how="left"), F.col("time_stamp").cast("double")
    return packed.select(
        SNAP,
        "part",
        F.struct(stamp.alias("time_stamp")).alias("graph"),
        F.lit(True).alias("directed"),
        F.lit(False).alias("multigraph"),
        "nodes",
        "links",
    )


def write_graphs(documents: DataFrame, path: str) -> None:
    """One JSON document per line."""
    documents.write.mode("append").option("compression", "gzip").json(path)


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of node-link documents; ``snapshot_id`` is taken from the document."""
    schema = T.StructType([T.StructField(SNAP, T.LongType()), *GRAPH_JSON.fields])
    docs = spark.read.schema(schema).json(path)
    nodes = docs.select(SNAP, F.col("graph.time_stamp").alias("time_stamp"), F.explode("nodes").alias("n")).select(
        SNAP, "time_stamp", F.col("n.id").alias("node"), "n.layer", "n.count", "n.size"
    )
    edges = docs.select(SNAP, F.explode("links").alias("l")).select(
        SNAP, F.col("l.source").alias("src"), F.col("l.target").alias("dst"), "l.count", "l.size"
    )
    return nodes, edges


def scored_documents(nodes: DataFrame, edges: DataFrame, scores: DataFrame, **options) -> DataFrame:
    """Graph documents with ``threshold`` and ``graph_as`` (the snapshot's score) attached."""
    docs = graph_documents(nodes, edges, **options)
    marks = scores.select(SNAP, "threshold", F.col("score").alias("graph_as"))
    return docs.join(marks, on=SNAP).withColumn(
        "graph", F.struct(F.col("graph.time_stamp").alias("time_stamp"), "threshold", "graph_as")
    ).drop("threshold", "graph_as")


def frame(df: DataFrame, number: int) -> DataFrame:
    """The rows of the ``number``-th snapshot, counting existing snapshots from 0 in time order.

    The smallest ``number + 1`` snapshot ids travel as one short sorted list.
    """
    ids = df.select(SNAP).distinct().orderBy(SNAP).limit(number + 1).agg(F.max(SNAP).alias("id"), F.count("*").alias("n"))
    wanted = ids.select(F.when(F.col("n") == number + 1, F.col("id")).alias("id")).scalar()
    return df.where(F.col(SNAP) == wanted)


def frame_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct(SNAP).alias("frames"))


def dataset_files(spark: SparkSession) -> DataFrame:
    """The registered files: (dataset, ord, state, file), the benign file of a dataset first."""
    week = [f"attack_samples/{d}/{a}" for d in WEEK_DEVICES for a in WEEK_ATTACKS]
    rows = []
    for dataset, files in (("test_data", [TEST_BENIGN, *TEST_ATTACKS]), ("UQ-IoT-IDS", [WEEK_BENIGN, *week])):
        rows += [(dataset, i, "loaded" if i else "new", file) for i, file in enumerate(files)]
    return spark.createDataFrame(rows, "dataset string, ord int, state string, file string")


def file_order(df: DataFrame, *, file: str = "file") -> DataFrame:
    """The files found in a table in processing order: benign first (state ``new``), the rest ``loaded``."""
    found = df.groupBy(file).agg(F.count("*").alias("rows"))
    benign = F.col(file).startswith("benign")
    # One row per file.
    place = Window.partitionBy(F.lit(0)).orderBy(F.when(benign, 0).otherwise(1), file)
    return found.select(
        file, "rows", F.when(benign, "new").otherwise("loaded").alias("state"), (F.row_number().over(place) - 1).alias("ord")
    )


def write_summary(summary: DataFrame, accuracy: DataFrame, path: str, run: Mapping[str, str]) -> None:
    """Store one run's summary row and file accuracies in folders by dataset, pipeline and run."""
    where = ["dataset_name", "pipeline_name", "run_identifier"]
    for name, df in (("summary", summary), ("accuracy", accuracy)):
        df.select("*", *[F.lit(run[c]).alias(c) for c in where]).write.mode("append").partitionBy(*where).parquet(f"{path}/{name}")


def read_summaries(spark: SparkSession, path: str, pattern: str = "") -> tuple[DataFrame, DataFrame]:
    """All stored summaries and file accuracies whose path matches ``pattern``."""

    def read(name: str) -> DataFrame:
        df = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").select("*", "_metadata.file_path")
        return df.where(F.col("file_path").rlike(pattern)) if pattern else df

    return read("summary"), read("accuracy")

"""Structured Streaming forms: landing source, windows, keyed statistics with expiry, metrics per batch."""

from __future__ import annotations

import pickle
import threading
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.functions.columns import CANCELLATION, decay_tag
from tidewire.operators.evaluate import batch_metrics
from tidewire.schema import DECAY_RATES, WEIGHT_FLOOR


def landing_packets(spark: SparkSession, path: str, schema: T.StructType, *, files_per_trigger: int | None = None) -> DataFrame:
    """Packet rows as they land in a folder (``schema`` holds an event time column)."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.parquet(path)


def window_counts(stream: DataFrame, *, window: str = "1 second", late: str = "10 seconds", time: str = "ts") -> DataFrame:
    """Rows per tumbling window; empty windows are not reported."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"))
        .agg(F.count("*").alias("frequency"))
        .select(F.col("w.start").alias("window_start"), "frequency")
    )


def window_nodes(
    stream: DataFrame, *, src: str, dst: str, window: str, late: str = "10 seconds", time: str = "ts", size: str = "packet_size"
) -> DataFrame:
    """Nodes of a one-layer snapshot graph: packets and bytes received minus sent per window."""
    ends = stream.withWatermark(time, late).selectExpr(
        time,
        size,
        f"explode(array(named_struct('node', {src}, 'sign', -1), named_struct('node', {dst}, 'sign', 1))) AS e",
    )
    return (
        ends.groupBy(F.window(time, window).alias("w"), F.col("e.node").alias("node"))
        .agg(F.sum("e.sign").alias("count"), F.sum(F.col("e.sign") * F.col(size)).alias("size"))
        .select(F.col("w.start").alias("window_start"), "node", "count", "size")
    )


def decayed_rows(t: np.ndarray, v: np.ndarray | None, last: float | None, sums: np.ndarray | None, rates: np.ndarray) -> tuple[np.ndarray, float]:
    """``decayed_keys`` of one key: the sums after every row and the last time."""
    sums = np.zeros((3, len(rates))) if sums is None else sums
    kept, clock = decayed_keys(t, v, np.array([0]), np.array([np.nan if last is None else last]), sums[None], rates)
    return kept, float(clock[-1])


def decayed_keys(t: np.ndarray, v: np.ndarray | None, starts: np.ndarray, last: np.ndarray, sums: np.ndarray, rates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decayed count, sum and square sum (row, 3, rate) after every row of its key, and the key's last time; ``v`` None takes the gaps.

    Rows lie key after key, in time order; ``starts`` names the first row of every key, ``last`` (NaN: none) and ``sums`` what
    its earlier rows have left. A row multiplies the sums by a factor and adds to them; such steps join into one step of the same kind,
    so after log(rows of the longest key) rounds every row holds all before it. At a key's first row, and where the slowest weight has died
    out, the factor is 0; rows of the second kind are found from the weights, again until no more appear (a restart can only lower later weights).
    """
    lengths = np.diff(np.append(starts, len(t)))
    clock = np.fmax(t, np.repeat(last, lengths))
    before = np.concatenate(([np.nan], clock[:-1]))
    before[starts] = last
    slow = int(np.argmin(rates))
    fresh = np.isnan(before)
    gone = clock - np.nan_to_num(before)
    while True:
        values = np.where(fresh, 0.0, t - np.nan_to_num(before)) if v is None else v
        factor = np.where(fresh[:, None], 0.0, np.exp2(-rates * gone[:, None]))
        kept = np.repeat(np.stack([np.ones(len(t)), values, values * values], axis=1)[:, :, None], len(rates), axis=2)
        kept[starts] += np.where(fresh[starts, None, None], 0.0, sums * factor[starts, None, :])
        factor[starts] = 0.0
        shift = 1
        while shift < lengths.max():
            passed = factor[shift:, None, :]  # 0 passes nothing on, not even a missing value
            kept[shift:] += np.multiply(passed, kept[:-shift], out=np.zeros_like(kept[shift:]), where=passed != 0)
            factor[shift:] *= factor[:-shift]
            shift *= 2
        weight = np.concatenate(([0.0], kept[:-1, 0, slow]))
        weight[starts] = sums[:, 0, slow]
        dead = ~fresh & (weight * np.exp2(-rates[slow] * gone) < WEIGHT_FLOOR)
        if not dead.any():
            return kept, clock
        fresh = fresh | dead


BUCKETS = 4096  # groups of keys whose state is kept together


def keyed_statistics(
    stream: DataFrame,
    key: str,
    value: str | None,
    *,
    time: str = "ts",
    late: str = "10 seconds",
    unit_seconds: float = 1.0,
    rates: Sequence[float] = DECAY_RATES,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Decayed weight, mean and deviation per row and key; without ``value`` of the gap to the key's last row.

    State per key: last time and three sums per rate. A key whose slowest weight has fallen below the floor
    is dropped by event-time timeout, and a returning key starts afresh. Rows of a trigger are taken in
    time order; ``unit_seconds`` is the time unit of the rates. Keys are dealt to ``buckets`` groups (fixed for the life of a
    checkpoint) whose keys share one state and are computed at once (``decayed_keys``), so many keys with few rows cost no call each.
    """
    rates_array = np.array(rates)
    slow = float(min(rates))
    tags = [decay_tag(r) for r in rates]
    stats = [f"stat_{tag}_{s}" for tag in tags for s in ("weight", "mean", "std")]
    output = T.StructType(
        [
            T.StructField("seq", T.LongType()),
            T.StructField("key", T.StringType()),
            T.StructField(time, T.TimestampType()),
            *[T.StructField(c, T.DoubleType()) for c in stats],
        ]
    )
    gaps = value is None

    def update(ids, batches, state: GroupState):
        names, last, sums = pickle.loads(state.get[0]) if state.exists else ([], np.empty(0), np.empty((0, 3, len(rates_array))))
        result = None
        if not state.hasTimedOut:
            rows = pd.concat(list(batches))
            codes, found = pd.factorize(rows["key"], use_na_sentinel=False)
            order = np.lexsort((rows["seq"], rows["_t"], codes))
            rows, codes = rows.iloc[order], codes[order]
            starts = np.flatnonzero(np.diff(codes, prepend=-1))
            found = [None if isinstance(name, float) else name for name in found]
            known = {name: place for place, name in enumerate(names)}
            places = np.array([known.get(name, -1) for name in found])
            old = places >= 0
            before, carried = np.full(len(found), np.nan), np.zeros((len(found), 3, len(rates_array)))
            before[old], carried[old] = last[places[old]], sums[places[old]]
            t, v = rows["_t"].to_numpy(float), None if gaps else rows["_v"].to_numpy(float)
            kept, clock = decayed_keys(t, v, starts, before, carried, rates_array)
            w, s, ss = kept[:, 0], kept[:, 1], kept[:, 2]
            safe = np.where(w < WEIGHT_FLOOR, 1.0, w)
            mean = np.where(w < WEIGHT_FLOOR, 0.0, s / safe)
            gap = np.abs(ss / safe - mean * mean)
            var = np.where((w < WEIGHT_FLOOR) | (gap <= CANCELLATION * ss / safe), 0.0, gap)
            out = np.stack([w, mean, np.sqrt(var)], axis=2).reshape(len(rows), len(stats))
            result = pd.DataFrame({"seq": rows["seq"], "key": rows["key"], time: rows[time], **dict(zip(stats, out.T, strict=True))})
            ends = np.append(starts[1:], len(rows)) - 1
            rest = np.ones(len(names), dtype=bool)
            rest[places[old]] = False
            names = [name for name, stays in zip(names, rest, strict=True) if stays] + found
            last, sums = np.concatenate((last[rest], clock[ends])), np.concatenate((sums[rest], kept[ends]))
        # The slowest weight of a key ends here; whatever comes later starts afresh.
        expiry = last + np.maximum(0.0, np.log2(sums[:, 0].max(axis=1) / WEIGHT_FLOOR)) / slow
        limits = (expiry * unit_seconds * 1000).astype("int64") + 1
        alive = limits > state.getCurrentWatermarkMs()
        if alive.any():
            names = [name for name, stays in zip(names, alive, strict=True) if stays]
            state.update((pickle.dumps((names, last[alive], sums[alive]), protocol=5),))
            state.setTimeoutTimestamp(int(limits[alive].min()))
        elif state.exists:
            state.remove()
        if result is not None:
            yield result

    rows = stream.withWatermark(time, late).selectExpr(
        "seq",
        f"cast({key} AS string) AS key",
        time,
        f"unix_micros({time}) / {unit_seconds * 1e6!r}D AS _t",
        f"cast({value or '0D'} AS double) AS _v",
        f"pmod(xxhash64(cast({key} AS string)), {buckets}) AS _bucket",
    )
    return rows.groupBy("_bucket").applyInPandasWithState(
        update, output, T.StructType([T.StructField("state", T.BinaryType())]), "append", GroupStateTimeout.EventTimeTimeout
    )


def metrics_to(
    scores: DataFrame, path: str, checkpoint: str, *, by: Sequence[str] = ("batch_id",), prepare: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Append the nine metrics of batches to the table ``path/closed``, one row per batch whatever triggers it spans.

    The last key of ``by`` numbers the batches of the stream that the others name; rows come batch after batch. The newest
    batch of each stream stays open: its rows wait in ``path/open`` until a row of a later batch closes it, or ``close_metrics``
    does at the end. Folders are named by the trigger's number and overwritten on a retry, so rows are written once.
    """
    spark = scores.sparkSession
    *stream, number = by

    def write(rows: DataFrame, trigger: int) -> None:
        chosen = prepare(rows) if prepare else rows
        waiting = _open_rows(spark, path, trigger, chosen.schema)
        held = chosen.unionByName(waiting) if waiting is not None else chosen
        held = held.persist()
        newest = held.groupBy(*stream).agg(F.max(number).alias("_newest"))
        marked = held.join(F.broadcast(newest), list(stream)) if stream else held.crossJoin(F.broadcast(newest))  # one row
        last = F.col(number) == F.col("_newest")
        batch_metrics(marked.where(~last).drop("_newest"), by=by).write.mode("overwrite").parquet(f"{path}/closed/trigger={trigger}")
        marked.where(last).drop("_newest").write.mode("overwrite").parquet(f"{path}/open/{trigger}")
        held.unpersist()

    return (
        scores.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _open_rows(spark: SparkSession, path: str, before: int | None, schema: T.StructType | None = None) -> DataFrame | None:
    """The rows of open batches that the last trigger (before ``before``) has left."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/open")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return None
    numbers = [int(s.getPath().getName()) for s in system.listStatus(folder)]
    numbers = [n for n in numbers if before is None or n < before]
    if not numbers:
        return None
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/open/{max(numbers)}")


def close_metrics(spark: SparkSession, path: str, *, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """End the stream: the metrics of all batches, also of those still open."""
    rest = _open_rows(spark, path, None)
    if rest is not None:
        batch_metrics(rest, by=by).write.mode("overwrite").parquet(f"{path}/closed/trigger=-1")
    return spark.read.parquet(f"{path}/closed").drop("trigger")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has landed and append the result to a Parquet table."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


class TriggerTimes(StreamingQueryListener):
    """Appends a row per trigger of any query to a table: the progress reports of a query forget old triggers, the table does not."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.ended = spark, path, set()
        self.change = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = (str(p.id), int(p.batchId), p.timestamp, int(p.numInputRows), p.durationMs.get("triggerExecution", 0) / 1000.0)
        self.spark.createDataFrame([row], TIMES).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryTerminated(self, event) -> None:
        with self.change:
            self.ended.add(str(event.id))
            self.change.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Until the reports of an ended query have arrived."""
        with self.change:
            self.change.wait_for(lambda: str(query.id) in self.ended, seconds)


TIMES = "query string, batch_num long, timestamp string, rows long, process_time double"


def process_times(spark: SparkSession, run: Callable[[], StreamingQuery], path: str) -> DataFrame:
    """Seconds and rows of every trigger of the query that ``run`` starts and finishes, stored below ``path``."""
    listener = TriggerTimes(spark, path)
    spark.streams.addListener(listener)
    try:
        query = run()
        query.awaitTermination()
        listener.wait(query)
    finally:
        spark.streams.removeListener(listener)
    return spark.read.schema(TIMES).parquet(path).where(F.col("query") == str(query.id)).drop("query")

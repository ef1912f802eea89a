"""Concepts per entity, drift of score levels and reliability of pooled models."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.operators.concepts import History
from tidewire.operators.folds import chunked_fold
from tidewire.operators.graph import edges_among
from tidewire.operators.index import running_totals
from tidewire.schema import CONCEPT_MAX_ROWS, CONCEPT_MIN_ROWS
from tidewire.session import settle


def concept_drift(
    rows: DataFrame,
    features: Sequence[str],
    *,
    entity: str = "node",
    order: str = "snapshot_id",
    min_rows: int = CONCEPT_MIN_ROWS,
    max_rows: int = CONCEPT_MAX_ROWS,
    chunk_rows: int = 50_000,
) -> DataFrame:
    """Assign each entity's rows to concepts and scale them by their concept's percentiles.

    Rows of zeros only get concept -1; rows still needed to start, or still in the buffer at the end, get
    none. Results carry the ``order`` value of the decided row itself. Entities run in parallel, and a long
    history runs in pieces of ``chunk_rows`` order values with the state handed over between rounds.
    """
    schema = T.StructType(
        [
            rows.schema[entity],
            rows.schema[order],
            *[T.StructField(f"original_{f}", T.DoubleType()) for f in features],
            *[T.StructField(f, T.DoubleType()) for f in features],
            T.StructField("concept_id", T.IntegerType()),
            T.StructField("malicious_concept", T.BooleanType()),
            T.StructField("num_concepts", T.IntegerType()),
        ]
    )
    features = list(features)
    names = schema.fieldNames()

    def step(state: tuple[History, np.ndarray], chunk: pd.DataFrame):
        history, waiting = state
        values, at = chunk[features].to_numpy(dtype=float), chunk[order].to_numpy()
        silent = ~values.any(axis=1)
        before, known = history.decided, max(1, len(history.concepts))
        started = history.arrived
        # The first rows only make a concept; they are never decided themselves.
        keys = np.concatenate((waiting, at[~silent][max(0, min_rows - started) :])).astype(at.dtype)
        rows, scaled, concept, malicious, many = history.arrive(values[~silent])
        # A silent row sees the concepts of the decisions that the rows before it have brought about.
        made = np.maximum(0, started + np.cumsum(~silent)[silent] - 2 * min_rows) - before
        seen = np.concatenate(([known], many))[np.maximum(made, 0)]
        ids = {entity: chunk[entity].iloc[0]}
        parts = (
            (keys[: len(rows)], rows, scaled, concept, malicious, many),
            (at[silent], values[silent], values[silent], np.full(silent.sum(), -1), np.zeros(silent.sum(), bool), seen),
        )
        out = []
        for when, original, result, number, evil, count in parts:
            columns = {f"original_{f}": original[:, i] for i, f in enumerate(features)} | {f: result[:, i] for i, f in enumerate(features)}
            flags = {"concept_id": number, "malicious_concept": evil, "num_concepts": count}
            out.append(pd.DataFrame({order: when, **columns, **flags}).assign(**ids)[names])
        return (history, keys[len(rows) :]), pd.concat(out)

    return chunked_fold(
        rows.select(entity, order, *features, F.floor(F.col(order) / F.lit(chunk_rows)).alias("_chunk")),
        step,
        schema,
        stream=[entity],
        order=[order],
        chunk="_chunk",
        initial=lambda: (History(len(features), min_rows, max_rows), np.empty(0)),
        speculate=False,
        pack=lambda state: (state[0].plain(), state[1]),
        unpack=lambda plain: (History.resumed(plain[0]), plain[1]),
    )


def concept_info(decided: DataFrame, *, entity: str = "node", order: str = "snapshot_id") -> DataFrame:
    """Latest concept and number of concepts per entity."""
    return (
        decided.where("concept_id >= 0")
        .groupBy(entity)
        .agg(
            F.max_by("concept_id", order).alias("current_concept_id"),
            F.max_by("num_concepts", order).alias("num_concepts"),
        )
    )


def scored_graph(decided: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that have a concept, and the edges between them."""
    nodes = decided.where("concept_id >= 0")
    return nodes, edges_among(edges, nodes)


def drift_levels(
    scores: DataFrame,
    *,
    stream: Sequence[str] = (),
    batch: str = "batch_id",
    row: str = "seq",
    patience: int = 1000,
    confidence: float = 50.0,
    max_models: int = 20,
) -> DataFrame:
    """Drift magnitude per batch from row scores ``scores(stream, batch, row, score, threshold)``; batches without scores are left out.

    A batch whose median lies above its threshold is suspicious: its median joins the suspicious queue, which empties
    once more than a fifth of ``patience`` batches in a row were not. The usual queue takes the medians of the other batches and
    the row scores of every batch, each after the batch is judged. Both queues hold the last ``patience`` values. When both are
    full the magnitude is ``patience * (difference of medians)**2 / range**2``, the range between the lowest 1 and the highest
    99 percentile. Above ``confidence`` it is malicious drift, else benign drift, which adds a model to the pool; both empty
    the suspicious queue.

    Queues are not folded row by row: suspicious batches between two long quiet stretches are numbered, every ``patience``-th
    of them completes a queue, and only the rows of the batches that its usual queue reaches back to are read. (A batch of
    two rows or more always leaves the usual queue full by then; streams of single-row batches are judged by what it holds.)
    """
    keys = list(stream) or ["_all"]
    rows = scores if stream else scores.withColumn("_all", F.lit(0))
    rows = rows.select(*keys, F.col(batch).alias("_batch"), F.col(row).alias("_row"), F.col("score").cast("double").alias("score"), "threshold")
    rows = settle(rows.where(F.col("score").isNotNull()))
    medians = rows.groupBy(*keys, "_batch").agg(
        F.expr("percentile(score, 0.5D)").alias("median"), F.max("threshold").alias("threshold"), F.count("*").alias("n")
    )
    judged = medians.withColumn("high", (F.col("median") > F.col("threshold")).cast("long"))
    judged = judged.withColumn("entries", F.col("n") + 1 - F.col("high")).withColumn("one", F.lit(1).cast("long"))
    placed = settle(running_totals(judged, ["entries", "one", "high"], ["_batch"], stream=keys))

    # Suspicious batches in order; a new stretch begins where too many others lie before one.
    quiet = patience // 5
    highs = placed.where("high = 1").select(*keys, "_batch", "median", F.col("entries_upto").alias("upto"), "entries", F.col("one_upto").alias("at"), F.col("high_upto").alias("h"))
    ahead = highs.select(*keys, (F.col("h") + 1).alias("h"), F.col("at").alias("last"))
    starts = highs.join(ahead, [*keys, "h"], "left").withColumn("start", (F.col("last").isNull() | (F.col("at") - F.col("last") - 1 > quiet)).cast("long"))
    stretches = running_totals(starts.select(*keys, "h", "start"), ["start"], ["h"], stream=keys).withColumnRenamed("start_upto", "stretch")
    first = stretches.groupBy(*keys, "stretch").agg(F.min("h").alias("h0"))
    queues = (
        highs.join(stretches.select(*keys, "h", "stretch"), [*keys, "h"])
        .join(first, [*keys, "stretch"])
        .groupBy(*keys, "stretch", F.floor((F.col("h") - F.col("h0")) / patience).alias("turn"))
        .agg(F.count("*").alias("size"), F.max("_batch").alias("_batch"), F.max(F.col("upto") - F.col("entries")).alias("end"), F.expr("percentile(median, array(0.01D, 0.5D, 0.99D))").alias("above"))
        .where(F.col("size") == patience)
    )
    queues = settle(queues.select(*keys, F.col("_batch").alias("_event"), "end", "above"))

    # The usual queue: the last entries before the batch. Queues of different events do not overlap, so entries go by blocks.
    span = F.lit(patience)
    reached = queues.select("*", F.explode(F.sequence(F.greatest(F.floor((F.col("end") - span) / span), F.lit(0).cast("long")), F.floor((F.col("end") - 1) / span))).alias("block"))
    entered = placed.select(*keys, "_batch", "median", "high", (F.col("entries_upto") - F.col("entries")).alias("before"), "entries")
    entered = entered.withColumn("block", F.explode(F.sequence(F.floor(F.col("before") / span), F.floor((F.col("before") + F.col("entries") - 1) / span))))
    meets = (F.col("before") < F.col("end")) & (F.col("before") + F.col("entries") > F.col("end") - span)
    touched = entered.join(reached, [*keys, "block"]).where(meets).select(*keys, "_batch", "_event", "end", "median", "high", "before").distinct()
    inside = Window.partitionBy(*keys, "_batch", "_event").orderBy("_row")
    own = rows.join(touched, [*keys, "_batch"]).select(
        *keys, "_event", "end", (F.col("before") + F.lit(1) - F.col("high") + F.row_number().over(inside) - 1).alias("e"), F.col("score").alias("v")
    )
    usual = own.unionByName(touched.where("high = 0").select(*keys, "_event", "end", F.col("before").alias("e"), F.col("median").alias("v")))
    below = usual.where((F.col("e") < F.col("end")) & (F.col("e") >= F.col("end") - span)).groupBy(*keys, "_event").agg(
        F.expr("percentile(v, array(0.01D, 0.5D, 0.99D))").alias("below")
    )
    gap = F.col("above")[1] - F.col("below")[1]
    reach = F.greatest(F.col("above")[2], F.col("below")[2]) - F.least(F.col("above")[0], F.col("below")[0])
    level = F.try_divide(F.lit(float(patience)) * gap * gap, reach * reach)
    events = queues.join(below, [*keys, "_event"]).select(*keys, F.col("_event").alias("_batch"), level.alias("drift_level"))
    events = events.withColumn("drift", F.when(F.col("drift_level") > confidence, "malicious").otherwise("benign"))
    marked = placed.select(*keys, "_batch").join(events, [*keys, "_batch"], "left")
    marked = settle(marked.withColumn("more", F.coalesce((F.col("drift") == "benign").cast("long"), F.lit(0).cast("long"))))
    counted = running_totals(marked.select(*keys, "_batch", "more"), ["more"], ["_batch"], stream=keys).drop("more")
    out = marked.join(counted, [*keys, "_batch"]).select(
        *keys,
        F.col("_batch").alias(batch),
        F.coalesce("drift_level", F.lit(0.0)).alias("drift_level"),
        F.coalesce("drift", F.lit("none")).alias("drift"),
        F.least(F.lit(max_models), F.col("more_upto") + 1).cast("int").alias("num_model"),
    )
    return out if stream else out.drop("_all")


def pool_reliability(
    scores: DataFrame, baselines: DataFrame, *, batch: Sequence[str] = ("batch_id",), model: str = "model"
) -> DataFrame:
    """Reliability of each pooled model on each batch and of the pool as a whole.

    It is no number (NaN) where all scores, now and in training, are one value.

    ``baselines(model, last_mean, last_min, last_max)`` describe the scores a model was trained on.
    """
    now = scores.groupBy(*batch, model).agg(
        F.avg("score").alias("mean"),
        F.min("score").alias("min"),
        F.max("score").alias("max"),
        F.count("*").alias("n"),
        F.stddev_pop("score").alias("std"),
    )
    joined = now.join(baselines, on=model)
    gap = F.col("mean") - F.col("last_mean")
    spread = F.greatest("max", "last_max") - F.least("min", "last_min")
    exponent = F.try_divide(-2 * gap * gap, (2 / F.col("n")) * spread * spread)
    reliability = F.exp(F.when(spread == 0, F.lit(float("nan"))).otherwise(exponent))
    return joined.withColumn("reliability", reliability).select(*batch, model, "reliability", "mean", "std", "n")


def pool_scores(
    scores: DataFrame, baselines: DataFrame, *, batch: Sequence[str] = ("batch_id",), model: str = "model", row: str = "seq"
) -> DataFrame:
    """Confidence-driven score per row: sum over models of reliability times the standardised score."""
    reliable = pool_reliability(scores, baselines, batch=batch, model=model)
    return (
        scores.join(reliable, on=[*batch, model])
        .groupBy(*batch, row)
        .agg(
            F.sum(F.col("reliability") * F.when(F.col("std") == 0, float("nan")).otherwise(F.try_divide(F.col("score") - F.col("mean"), F.col("std")))).alias("score"),
            (1 - F.product(1 - F.col("reliability"))).alias("drift_level"),
        )
    )

"""Models of streams that score a batch by what earlier batches have taught them (test, then train)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.operators.detect import adaptive_threshold, correlation_clusters
from tidewire.operators.linear import Moments
from tidewire.operators.scan import STATE, exclusive_scan
from tidewire.schema import QUEUE_ROWS, THRESHOLD_QUANTILE, TOLERANCE, WARMUP_BATCHES
from tidewire.session import settle, staging_path

BLOCK_BATCHES = 32  # batches that a task scores in a row


class MeanAndCross:
    """State of d features: count, means and centred cross products in one array. Merging adds two tables of rows."""

    def __init__(self, d: int) -> None:
        self.d = d

    def summary(self, x: np.ndarray) -> np.ndarray:
        mean = x.mean(axis=0) if len(x) else np.zeros(self.d)
        gap = x - mean
        return np.concatenate(([len(x)], mean, (gap.T @ gap).ravel()))

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = a[0] + b[0]
        if a[0] == 0 or b[0] == 0:
            return b if a[0] == 0 else a
        gap = b[1 : self.d + 1] - a[1 : self.d + 1]
        mean = a[1 : self.d + 1] + gap * (b[0] / n)
        cross = a[self.d + 1 :] + b[self.d + 1 :] + np.outer(gap, gap).ravel() * (a[0] * b[0] / n)
        return np.concatenate(([n], mean, cross))

    def parts(self, state: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Count, means, covariance."""
        return state[0], state[1 : self.d + 1], state[self.d + 1 :].reshape(self.d, self.d) / state[0]


@dataclass
class Reconstruction:
    """Linear autoencoder with ``k`` latent dimensions: mean squared error of rebuilding a row from the leading axes."""

    d: int
    k: int

    def __post_init__(self) -> None:
        self.state, self.outputs = MeanAndCross(self.d), 1

    def score(self, state: np.ndarray, x: np.ndarray) -> np.ndarray:
        _, mean, covariance = self.state.parts(state)
        axes = np.linalg.eigh(covariance)[1][:, self.d - self.k :]
        gap = x - mean
        rest = gap - (gap @ axes) @ axes.T
        return (rest * rest).sum(axis=1, keepdims=True) / self.d


@dataclass
class ClusterErrors:
    """One linear autoencoder per cluster of features; a row's vector of root mean squared errors."""

    d: int
    clusters: list[list[int]]
    compression: float = 0.75

    def __post_init__(self) -> None:
        self.state, self.outputs = MeanAndCross(self.d), len(self.clusters)
        # The errors of all clusters are block sums of one matrix of residuals.
        self.member = np.zeros((self.d, len(self.clusters)))
        for i, cluster in enumerate(self.clusters):
            self.member[cluster, i] = 1 / len(cluster)

    def score(self, state: np.ndarray, x: np.ndarray) -> np.ndarray:
        _, mean, covariance = self.state.parts(state)
        basis = np.zeros((self.d, self.d))  # block diagonal projection on all clusters' axes
        for cluster in self.clusters:
            k = latent(len(cluster), self.compression)
            axes = np.linalg.eigh(covariance[np.ix_(cluster, cluster)])[1][:, len(cluster) - k :]
            basis[np.ix_(cluster, cluster)] = axes @ axes.T
        gap = x - mean
        rest = gap - gap @ basis
        return np.sqrt((rest * rest) @ self.member + 1e-7)


def latent(size: int, compression: float) -> int:
    return min(size, max(1, int(np.ceil(size * compression)) - (size > 1)))


@dataclass
class Transformations:
    """Random linear images of a row told apart by their distance to the running mean images.

    As the images are linear, the mean image is the image of the mean. The running mean is the mean of the batches' means,
    so the state is their number and their sum.
    """

    d: int
    transforms: int = 8
    dim: int = 4
    seed: int = 0

    def __post_init__(self) -> None:
        self.state, self.outputs = self, 1
        self.weights = np.random.default_rng(self.seed).normal(size=(self.transforms, self.d, self.dim))

    def summary(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate(([1.0], x.mean(axis=0))) if len(x) else np.zeros(self.d + 1)

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b

    def score(self, state: np.ndarray, x: np.ndarray) -> np.ndarray:
        means = np.einsum("n,anm->am", state[1:] / state[0], self.weights)
        images = np.einsum("bn,anm->bam", x, self.weights)
        distance = ((images[:, :, None, :] - means[None, None]) ** 2).sum(axis=3)
        lowest = distance.min(axis=2, keepdims=True)
        total = np.log(np.exp(lowest - distance).sum(axis=2)) - lowest[:, :, 0]
        return (np.diagonal(distance, axis1=1, axis2=2) + total).sum(axis=1, keepdims=True)


def prequential_scores(
    df: DataFrame,
    features: Sequence[str],
    model,
    *,
    batch: str = "batch_id",
    stream: Sequence[str] = (),
    trains: str | None = None,
    names: Sequence[str] = ("score",),
    block_batches: int = BLOCK_BATCHES,
) -> DataFrame:
    """``df`` with the model's scores of every row, by the rows of earlier batches of its stream only.

    ``model`` has ``state`` (``summary`` of rows, ``merge`` of two neighbours) and ``score`` (state, rows). ``trains`` is a
    boolean column: other rows are scored but teach nothing. Rows with a missing feature neither teach nor get a
    score; the rows before which nothing was taught have none (null). Blocks of batches are summed side by side, a prefix
    scan over the blocks' states gives what came before each block, and a block's batches are then scored one after
    the other: rows are shuffled once by (stream, block), read twice, and no task holds more than a block.
    """
    stream, features = list(stream), list(features)
    keys = [*stream, "_block"]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    complete = F.lit(True)
    for f in features:
        complete = complete & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    rows = df.withColumn("_block", F.floor(F.col(batch) / F.lit(block_batches))).withColumn("_x", F.when(complete, F.array(*[F.col(f).cast("double") for f in features])))
    rows = rows.withColumn("_t", (F.coalesce(F.col(trains), F.lit(False)) if trains else F.lit(True)) & F.col("_x").isNotNull())
    rows = rows.repartition(tasks, *keys)
    state = model.state

    def total(block: pd.DataFrame) -> pd.DataFrame:
        taught = block[block["_t"]]
        merged = None
        for _, one in taught.groupby(batch, sort=True):
            own = state.summary(np.stack(one["_x"].to_numpy()))
            merged = own if merged is None else state.merge(merged, own)
        first = block.iloc[[0]][keys]
        return first.assign(state=[state.summary(np.zeros((0, len(features)))) if merged is None else merged])

    block_schema = rows.select(*keys).schema.add("state", STATE)
    sums = settle(rows.select(*keys, batch, "_x", "_t").groupBy(*keys).applyInPandas(total, block_schema))
    entry = exclusive_scan(sums, state.merge, stream=stream, position="_block").select(*keys, "before")
    out = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def scored(block: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        held = None
        if len(before) and before["before"].iloc[0] is not None:
            held = np.asarray(before["before"].iloc[0])
        result = np.full((len(block), len(names)), np.nan)
        block = block.reset_index(drop=True)
        for _, one in block.groupby(batch, sort=True):
            known = one.index[one["_x"].notna()]
            if held is not None and held[0] > 0 and len(known):
                result[known] = model.score(held, np.stack(one["_x"][known].to_numpy()))
            taught = one.index[one["_t"]]
            if len(taught):
                own = state.summary(np.stack(one["_x"][taught].to_numpy()))
                held = own if held is None else state.merge(held, own)
        return block.assign(**{n: pd.Series(result[:, i]).astype("Float64").where(~np.isnan(result[:, i])) for i, n in enumerate(names)})[out.fieldNames()]

    return rows.groupBy(*keys).cogroup(entry.groupBy(*keys)).applyInPandas(scored, out)


def reconstruction_stream(df: DataFrame, features: Sequence[str], k: int, **options) -> DataFrame:
    """Reconstruction errors of a linear autoencoder that has seen the earlier batches."""
    return prequential_scores(df, features, Reconstruction(len(features), k), **options)


def transformation_stream(df: DataFrame, features: Sequence[str], *, transforms: int = 8, dim: int = 4, seed: int = 0, **options) -> DataFrame:
    """Transformation scores against the running means of the earlier batches."""
    return prequential_scores(df, features, Transformations(len(features), transforms, dim, seed), **options)


def warmup_clusters(df: DataFrame, features: Sequence[str], *, batch: str = "batch_id", warmup: int, max_size: int, min_size: int = 4) -> list[list[int]]:
    """Groups of correlated features from the first ``warmup`` batches; the groups stay as they are from then on."""
    state = MeanAndCross(len(features))
    first = df.where(F.col(batch) < warmup).select(F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    first = first.where(F.forall("_x", lambda v: v.isNotNull()))

    def sums(batches):
        held = None
        for rows in batches:
            if len(rows):
                own = state.summary(np.stack(rows["_x"].to_numpy()))
                held = own if held is None else state.merge(held, own)
        if held is not None:
            yield pd.DataFrame({"state": [held]})

    merged = None  # one small state a task
    for row in first.mapInPandas(sums, "state array<double>").toLocalIterator():
        merged = np.array(row["state"]) if merged is None else state.merge(merged, np.array(row["state"]))
    if merged is None:
        return [list(range(len(features)))]
    n, mean, covariance = state.parts(merged)
    return correlation_clusters(Moments(n, mean * n, (covariance + np.outer(mean, mean)) * n), max_size, min_size)


def ensemble_stream(
    df: DataFrame, features: Sequence[str], *, warmup: int, max_size: int, compression: float = 0.75, batch: str = "batch_id", clusters=None, **options
) -> DataFrame:
    """Root mean squared errors per feature cluster, then of the error vector: the final score; both by earlier batches only.

    The clusters come from the first ``warmup`` batches (of all streams) unless they are given.
    """
    groups = clusters or warmup_clusters(df, features, batch=batch, warmup=warmup, max_size=max_size)
    errors = [f"_error{i}" for i in range(len(groups))]
    first = prequential_scores(df, features, ClusterErrors(len(features), groups, compression), batch=batch, names=errors, **options)
    if len(groups) == 1:
        return first.withColumnRenamed("_error0", "score")
    head = Reconstruction(len(groups), latent(len(groups), compression))
    scored = prequential_scores(first, errors, head, batch=batch, **options)
    return scored.withColumn("score", F.sqrt(F.col("score") + 1e-7)).drop(*errors)


def feedback_scores(
    df: DataFrame,
    features: Sequence[str],
    model,
    *,
    row: str = "seq",
    batch: str = "batch_id",
    stream: Sequence[str] = (),
    queue: int = QUEUE_ROWS,
    p: float = THRESHOLD_QUANTILE,
    warmup: int = WARMUP_BATCHES,
    tolerance: float = TOLERANCE,
    chunk_batches: int = 512,
) -> DataFrame:
    """Test, then train with feedback: (stream, batch, row, score, threshold, trained).

    After the warm-up only rows that score below ``tolerance`` times the threshold teach the model and enter the queue. What is
    trained depends on the scores and these on what was trained, batch after batch; here all batches run at once from
    a guess (every row teaches), and the resulting choice is tried again until it confirms itself. Then it is the choice
    of the batch by batch run: the first batch that differed would rest on equal batches before it. Each
    round settles at least one more batch, in practice a few rounds do. Rows without a score do not teach after the
    warm-up.
    """
    stream = list(stream)
    ids = [*stream, batch, row]
    base = settle(df.select(*ids, *features))
    chosen = base.withColumn("_teach", F.lit(True))
    while True:
        scored = settle(prequential_scores(chosen, features, model, batch=batch, stream=stream, trains="_teach"))
        judged = adaptive_threshold(
            scored.select(*ids, F.coalesce("score", F.lit(float("nan"))).alias("score")), batch=batch, row=row, stream=stream,
            queue=queue, p=p, warmup=warmup, tolerance=tolerance, chunk_batches=chunk_batches,
        )
        judged = settle(judged.select(*ids, F.nanvl("score", F.lit(None).cast("double")).alias("score"), "threshold", "trained"))
        changed = judged.join(chosen.select(*ids, "_teach"), ids).where("trained <> _teach")
        if changed.isEmpty():
            return judged
        chosen = settle(base.join(judged.select(*ids, F.col("trained").alias("_teach")), ids))


def one_class_stream(
    df: DataFrame,
    features: Sequence[str],
    *,
    batch: str = "batch_id",
    nu: float = 0.05,
    rate: float = 0.5,
    steps: int = 1,
    group_batches: int = 16,
) -> DataFrame:
    """``df`` with the signed distance (``score``) to a linear one-class boundary that has learnt from earlier groups of batches only.

    The boundary ``w x = rho`` starts at 0 and 1. Every group of ``group_batches`` batches moves it by ``steps`` sub-gradient steps on the
    group's rows (step i of the stream has rate ``rate / sqrt(i)``): partial sums per Arrow batch, added up in a tree. Groups are
    stored as folders, so a step reads its own rows only and the whole stream is read ``steps`` times to learn and once to
    score; the boundaries of all groups are a short list. Rows of the first group, and rows with a missing feature, have none.
    """
    features = list(features)
    d = len(features)
    spark = df.sparkSession
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    rows = df.select(F.floor(F.col(batch) / F.lit(group_batches)).alias("_group"), F.array(*[F.col(f).cast("double") for f in features]).alias("x")).where(whole)
    path = staging_path(spark, "groups")
    rows.write.partitionBy("_group").parquet(path)
    stored = spark.read.schema("x array<double>, _group long").parquet(path)
    groups = sorted(r[0] for r in stored.select("_group").distinct().collect())  # a short list
    w, rho, step = np.zeros(d), 1.0, 0
    before: dict[int, tuple[np.ndarray, float]] = {}
    for number, group in enumerate(groups):
        if number:
            before[group] = (w, rho)
        for _ in range(steps):
            step += 1
            w, rho = _boundary_step(stored.where(F.col("_group") == group).select("x"), w, rho, nu, rate / np.sqrt(step))
    known = spark.sparkContext.broadcast(before)
    starts = np.array(groups[1:], dtype=np.int64)
    out = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])

    def score(batches):
        for part in batches:
            x = part[features].astype(float).to_numpy()
            at = np.searchsorted(starts, (part[batch] // group_batches).to_numpy("int64"), side="right") - 1
            values = np.full(len(part), np.nan)
            for i in np.unique(at[at >= 0]):
                weights, edge = known.value[int(starts[i])]
                values[at == i] = x[at == i] @ weights - edge
            yield part.assign(score=pd.Series(values, index=part.index).astype("Float64").where(~np.isnan(values)))

    return df.mapInPandas(score, out)


def _boundary_step(rows: DataFrame, w: np.ndarray, rho: float, nu: float, rate: float) -> tuple[np.ndarray, float]:
    """One sub-gradient step: rows on the wrong side of the boundary pull it."""

    def sums(batches):
        total = np.zeros(len(w) + 2)
        for part in batches:
            if len(part):
                x = np.stack(part["x"].to_numpy())
                inside = x @ w < rho
                total += np.concatenate(([len(x), inside.sum()], x[inside].sum(axis=0)))
        yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    found = dict(rows.mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v")).collect())
    n = max(found.get(0, 0.0), 1.0)
    pull = np.array([found.get(i + 2, 0.0) for i in range(len(w))]) / n
    return w - rate * (nu * w - pull), float(rho - rate * (found.get(1, 0.0) / n - nu))

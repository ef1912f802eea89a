"""Anomaly scores, self-adjusting thresholds and models from distributed sums."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.operators.folds import chunked_fold
from tidewire.operators.linear import Moments, dot, linear_cka, moments, principal_axes, reconstruction_error
from tidewire.operators.scale import earlier_batches
from tidewire.schema import (
    BATCH_ROWS,
    QUEUE_ROWS,
    THRESHOLD_QUANTILE,
    TOLERANCE,
    WARMUP_BATCHES,
    WARMUP_SPLIT,
)


def deviation_scores(
    df: DataFrame, features: Sequence[str], *, batch: str = "batch_id", stream: Sequence[str] = (), **options
) -> DataFrame:
    """Largest distance from the mean in units of the 16-84 range, against all earlier batches.

    A column without earlier data, or whose distance is no number, does not count; the score starts at 0.
    """
    state = earlier_batches(df, features, batch=batch, stream=stream, own_first=False, **options)
    rows = df.join(state, on=[*stream, batch])
    parts = []
    for f in features:
        spread = f"({f}_q2 - {f}_q0)"
        gap = f"abs({f} - {f}_mean)"
        parts.append(
            f"CASE WHEN {f}_mean IS NULL OR {f} IS NULL THEN 0D WHEN {spread} <> 0 THEN {gap} / {spread}"
            f" WHEN {gap} > 0 THEN double('infinity') ELSE 0D END"
        )
    score = f"greatest({', '.join([*parts, '0D'])})"
    return rows.selectExpr(*[f"`{c}`" for c in df.columns], f"{score} AS score")


def rolling_threshold(
    scores: DataFrame,
    *,
    batch: str = "batch_id",
    position: str = "seq",
    stream: Sequence[str] = (),
    rows_per_batch: int = BATCH_ROWS,
    queue: int = QUEUE_ROWS,
    p: float = THRESHOLD_QUANTILE,
    warmup: int = WARMUP_BATCHES,
) -> DataFrame:
    """Threshold per batch: the quantile of the ``queue`` scores before it, -1 while warming up, null without scores.

    ``position`` numbers the stream's rows densely and batches hold ``rows_per_batch`` of them. Blocks of at least 64 batches
    and four queues are judged side by side, each with the queue of rows before it, so most rows are sent once and
    groups are bounded whatever the size of the stream. Rows carried over from before the stream have
    negative positions and no batch.
    """
    stream = list(stream)
    batches = max(64, -(-4 * queue // rows_per_batch))
    size = batches * rows_per_batch
    blocks = F.sequence(F.greatest(F.floor(F.col(position) / F.lit(size)), F.lit(0).cast("long")), F.floor((F.col(position) + queue) / F.lit(size)))
    dealt = scores.where(F.col(position) >= -queue).select(
        *stream, F.explode(blocks).alias("_block"), F.col(position).alias("_at"), F.col(batch).cast("long").alias("_batch"), F.col("score").cast("double").alias("score")
    )
    schema = scores.select(*stream, F.col(batch).cast("long").alias(batch)).schema.add("threshold", "double")
    keys = [*stream, "_block"]

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at", kind="stable")
        at, values = rows["_at"].to_numpy("int64"), rows["score"].to_numpy(float)
        first = int(rows["_block"].iloc[0]) * batches
        own = np.unique(rows["_batch"].dropna().to_numpy("int64"))
        own = own[(own >= first) & (own < first + batches)]
        edges = np.searchsorted(at, np.concatenate((own * rows_per_batch - queue, own * rows_per_batch)))
        found = [-1.0 if b < warmup else interpolated(values[low:high], p) for b, low, high in zip(own, edges[: len(own)], edges[len(own) :], strict=True)]
        ids = rows.iloc[[0] * len(own)][stream].reset_index(drop=True)
        return ids.assign(**{batch: own, "threshold": pd.array(found, dtype="Float64")})

    return dealt.groupBy(*keys).applyInPandas(judge, schema)


def interpolated(values: np.ndarray, p: float) -> float | None:
    """A quantile between its two neighbours; missing values do not count."""
    values = values[~np.isnan(values)]
    if not len(values):
        return None
    rank = p * (len(values) - 1)
    low, high = int(np.floor(rank)), int(np.ceil(rank))
    a, b = np.partition(values, (low, high))[[low, high]]
    return float(a if a == b else (high - rank) * a + (rank - low) * b)


@dataclass
class Queue:
    batches: int = 0
    scores: np.ndarray = field(default_factory=lambda: np.empty(0))


def adaptive_threshold(
    scores: DataFrame,
    *,
    batch: str = "batch_id",
    row: str = "seq",
    stream: Sequence[str] = (),
    queue: int = QUEUE_ROWS,
    p: float = THRESHOLD_QUANTILE,
    warmup: int = WARMUP_BATCHES,
    tolerance: float = TOLERANCE,
    chunk_batches: int = 2048,
) -> DataFrame:
    """Test-then-train threshold with feedback: ``threshold`` and ``trained`` per score.

    The threshold of a batch is the quantile of the queued scores, -1 during ``warmup`` batches. The first
    80 % of the warm-up queue nothing, the rest everything; later only scores below ``tolerance`` times the
    threshold train and enter the queue of the last ``queue`` scores.

    The queue mostly forgets its start, so a stream is folded in pieces of ``chunk_batches`` batches at once. Where feedback keeps
    every later score out it does not; such pieces take a round each.
    """
    keys = list(stream) or ["_all"]
    rows = scores if stream else scores.withColumn("_all", F.lit(0))
    schema = T.StructType(
        [
            *[rows.schema[k] for k in keys],
            rows.schema[batch],
            rows.schema[row],
            T.StructField("score", T.DoubleType()),
            T.StructField("threshold", T.DoubleType()),
            T.StructField("trained", T.BooleanType()),
        ]
    )

    def guess(chunk: int) -> Queue:
        return Queue(chunk * chunk_batches)

    def step(state: Queue, piece: pd.DataFrame):
        out = []
        for _, one in piece.groupby(batch, sort=True):
            values = one["score"].to_numpy(dtype=float)
            warm = state.batches < warmup
            threshold = -1.0 if warm else (float(np.quantile(state.scores, p)) if len(state.scores) else np.nan)
            if warm or not len(state.scores):
                trained = np.ones(len(values), dtype=bool)
                queued = values if state.batches >= warmup * WARMUP_SPLIT else values[:0]
            else:
                trained = values < tolerance * threshold
                queued = values[trained]
            state.scores = np.concatenate((state.scores, queued))[-queue:]
            state.batches += 1
            out.append(one.assign(threshold=threshold, trained=trained))
        return state, pd.concat(out)

    result = chunked_fold(
        rows.select(*keys, batch, row, F.col("score").cast("double"), F.floor(F.col(batch) / F.lit(chunk_batches)).alias("_chunk")),
        step,
        schema,
        stream=keys,
        order=[batch, row],
        chunk="_chunk",
        initial=lambda: guess(0),
        guess=guess,
        pack=lambda state: (state.batches, state.scores.copy()),
        unpack=lambda plain: Queue(*plain),
    )
    return result if stream else result.drop("_all")


# Linear reconstruction models. A model is a handful of d x d numbers, so it can be stored as a table row.


def fit_axes(df: DataFrame, features: Sequence[str], k: int) -> tuple[Moments, np.ndarray]:
    m = moments(df, features)[()]
    return m, principal_axes(m, k)[0]


def reconstruction_scores(df: DataFrame, features: Sequence[str], k: int, *, model=None, name: str = "score") -> DataFrame:
    """Mean squared reconstruction error of a linear autoencoder with ``k`` latent dimensions."""
    m, axes = model or fit_axes(df, features, k)
    return df.selectExpr("*", f"{reconstruction_error(features, m, axes)} AS {name}")


def correlation_clusters(m: Moments, max_size: int, min_size: int = 4) -> list[list[int]]:
    """Groups of correlated features: single linkage on ``1 - correlation``, cut to ``max_size`` features.

    Groups below ``min_size`` are joined: two small ones with each other, a last one with the smallest.
    """
    spread = np.sqrt(np.diag(m.covariance))
    both = np.outer(spread, spread)
    distance = np.maximum(1.0 - m.covariance / np.where(both == 0, 1e-16, both), 0.0)
    d = len(distance)
    # Single linkage joins along the edges of a minimum spanning tree in order of length.
    inside, links = [0], []
    near, parent = distance[0].copy(), np.zeros(d, dtype=int)
    near[0] = np.inf
    while len(inside) < d:
        new = int(np.argmin(near))
        links.append((near[new], int(parent[new]), new))
        inside.append(new)
        near[new] = np.inf
        closer = distance[new] < near
        closer[inside] = False
        near[closer], parent[closer] = distance[new][closer], new
    trees: dict[int, object] = {i: i for i in range(d)}
    members = {i: [i] for i in range(d)}
    home = list(range(d))
    for _, a, b in sorted(links):
        a, b = home[a], home[b]
        trees[a], members[a] = (trees[a], trees.pop(b)), members[a] + members.pop(b)
        for i in members[a]:
            home[i] = a

    def leaves(tree) -> list[int]:
        return [tree] if isinstance(tree, int) else leaves(tree[0]) + leaves(tree[1])

    def split(tree) -> list[list[int]]:
        found = leaves(tree)
        return [found] if len(found) <= max_size else split(tree[0]) + split(tree[1])

    groups = split(trees[home[0]])
    while len(groups) > 1:
        small = [g for g in groups if len(g) < min_size]
        if not small:
            break
        rest = [g for g in groups if g is not small[0]]
        partner = small[1] if len(small) > 1 else min(rest, key=len)
        groups = [g for g in rest if g is not partner] + [small[0] + partner]
    return groups


def ensemble_scores(df: DataFrame, features: Sequence[str], *, max_size: int, compression: float = 0.75) -> DataFrame:
    """Reconstruction error per feature cluster, then of the error vector: the final score.

    All clusters are scored in one pass over the rows.
    """
    m = moments(df, features)[()]
    groups = correlation_clusters(m, max_size)
    errors = []
    for number, group in enumerate(groups):
        part = Moments(m.n, m.total[group], m.cross[np.ix_(group, group)])
        names = [features[i] for i in group]
        k = max(1, int(np.ceil(len(group) * compression)) - (len(group) > 1))
        axes, _ = principal_axes(part, min(k, len(group)))
        errors.append(f"sqrt({reconstruction_error(names, part, axes)} + 1e-7D) AS _rmse{number}")
    scored = df.selectExpr("*", *errors)
    names = [f"_rmse{i}" for i in range(len(groups))]
    if len(names) == 1:
        return scored.withColumnRenamed("_rmse0", "score")
    k = max(1, int(np.ceil(len(names) * compression)) - 1)
    head, axes = fit_axes(scored, names, k)
    return scored.selectExpr(
        *[f"`{c}`" for c in df.columns], f"sqrt({reconstruction_error(names, head, axes)} + 1e-7D) AS score"
    )


def one_class_svm(
    df: DataFrame, features: Sequence[str], *, nu: float = 0.05, iterations: int = 20, rate: float = 0.5
) -> tuple[np.ndarray, float]:
    """Linear one-class boundary by full-batch sub-gradient steps, one small aggregate per step."""
    w, rho = np.zeros(len(features)), 1.0
    for i in range(1, iterations + 1):
        inside = F.expr(f"{dot(features, w)} < {rho!r}D")
        row = df.agg(F.avg(F.when(inside, 1.0).otherwise(0.0)), *[F.avg(F.when(inside, F.col(f)).otherwise(0.0)) for f in features]).first()
        share, pull = float(row[0]), np.array(row[1:], dtype=float)
        step = rate / np.sqrt(i)
        w = w - step * (nu * w - pull)
        rho = float(rho - step * (share - nu))
    return w, rho


def one_class_scores(df: DataFrame, features: Sequence[str], w: np.ndarray, rho: float) -> DataFrame:
    return df.selectExpr("*", f"{dot(features, w, -rho)} AS score")


def transformation_scores(
    df: DataFrame, features: Sequence[str], *, transforms: int = 8, dim: int = 4, seed: int = 0
) -> DataFrame:
    """How badly a row's random linear images can be told apart by their distance to the mean images.

    The means of linear images are the images of the mean, so one aggregate fits the model.
    """
    features = list(features)
    weights = np.random.default_rng(seed).normal(size=(transforms, len(features), dim))
    centre = np.array(df.agg(*[F.avg(f) for f in features]).first(), dtype=float)
    means = np.einsum("n,anm->am", centre, weights)

    def score(batches):
        for batch in batches:
            x = batch[features].to_numpy(dtype=float)
            images = np.einsum("bn,anm->bam", x, weights)
            distance = ((images[:, :, None, :] - means[None, None]) ** 2).sum(axis=3)
            lowest = distance.min(axis=2, keepdims=True)
            log_total = np.log(np.exp(lowest - distance).sum(axis=2)) - lowest[:, :, 0]
            own = np.diagonal(distance, axis1=1, axis2=2)
            yield batch.assign(score=(own + log_total).sum(axis=1))

    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])
    return df.mapInPandas(score, schema)


def score_with(df: DataFrame, features: Sequence[str], load: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """Score rows with any user model: ``load()`` runs once per task and returns ``matrix -> scores``."""
    features = list(features)

    def score(batches):
        predict = load()
        for batch in batches:
            yield batch.assign(score=np.asarray(predict(batch[features].to_numpy(dtype=float)), dtype=float))

    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])
    return df.mapInPandas(score, schema)


def fit_pool(df: DataFrame, features: Sequence[str], *, group: str) -> dict[object, Moments]:
    """One linear model per group value (a short list such as files)."""
    return {key[0]: m for key, m in moments(df, features, group=[group]).items()}


def merge_most_similar(
    df: DataFrame, features: Sequence[str], pool: Mapping[object, Moments], *, k: int, least: float = 0.8
) -> tuple[dict[object, Moments], DataFrame]:
    """Merge the newest model with the most similar older one, judged on the rows of ``df``.

    Similarity is the linear CKA of the models' latent rows; merging adds the models' sums, which is exact
    for a linear model. Returns the new pool and the table of similarities.
    """
    names = list(pool)
    latent = {}
    texts = []
    for number, name in enumerate(names):
        axes, _ = principal_axes(pool[name], k)
        latent[name] = [f"_l{number}_{i}" for i in range(k)]
        texts += [
            f"{dot(features, axis, -float(axis @ pool[name].mean))} AS {c}"
            for axis, c in zip(axes, latent[name], strict=True)
        ]
    projected = df.selectExpr(*texts)
    newest = names[-1]
    found = None
    for name in names[:-1]:
        one = linear_cka(projected, latent[name], latent[newest]).select(
            F.lit(str(name)).alias("model"), F.lit(str(newest)).alias("other"), "cka"
        )
        found = one if found is None else found.unionByName(one)
    best = found.orderBy(F.desc("cka"), "model").first()
    if best is None or best["cka"] < least:
        return dict(pool), found
    partner = next(n for n in names if str(n) == best["model"])
    merged = {n: m for n, m in pool.items() if n not in (partner, newest)}
    merged[newest] = pool[partner] + pool[newest]
    return merged, found

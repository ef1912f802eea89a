"""Batch metrics, run summaries, average precision and comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.columns import cap_infinite, ratio_or
from tidewire.operators.index import running_totals

# Column names of the published results.
METRICS = (
    "detection_rate",
    "lower_quartile_score",
    "upper_quartile_score",
    "soft_min_score",
    "soft_max_score",
    "median_score",
    "median_threshold",
    "pos_count",
    "batch_size",
)


def batch_metrics(scores: DataFrame, *, by: Sequence[str] = ("batch_id",), time: str | None = None) -> DataFrame:
    """The nine metrics per batch of ``scores(score, threshold)``; a missing score is null.

    The detection rate divides by all rows. A batch without any score reports 0 throughout (the threshold
    keeps its median). Groups are batches, so the exact percentiles work on a batch's rows only.
    """
    probs = "array(0.01D, 0.25D, 0.5D, 0.75D, 0.99D)"
    found = scores.groupBy(*by).agg(
        F.count("score").alias("_scored"),
        F.count("*").alias("_rows"),
        F.count_if(F.col("score") > F.col("threshold")).alias("_pos"),
        F.expr(f"percentile(score, {probs}) AS _q"),
        F.expr("coalesce(percentile(threshold, 0.5D), 0D) AS median_threshold"),
        *([F.max(time).alias(time)] if time else []),
    )
    some = F.col("_scored") > 0

    def metric(column) -> F.Column:
        return F.when(some, column).otherwise(F.lit(0))

    return found.select(
        *by,
        *([time] if time else []),
        metric(F.col("_pos") / F.col("_rows")).alias("detection_rate"),
        metric(F.col("_q")[1]).alias("lower_quartile_score"),
        metric(F.col("_q")[3]).alias("upper_quartile_score"),
        metric(F.col("_q")[0]).alias("soft_min_score"),
        metric(F.col("_q")[4]).alias("soft_max_score"),
        metric(F.col("_q")[2]).alias("median_score"),
        "median_threshold",
        metric(F.col("_pos")).cast("long").alias("pos_count"),
        metric(F.col("_rows")).cast("long").alias("batch_size"),
    )


def positives(scores: DataFrame) -> DataFrame:
    """Rows above their threshold."""
    return scores.where(F.col("score") > F.col("threshold"))


def clean_metrics(metrics: DataFrame, columns: Sequence[str] = METRICS) -> DataFrame:
    """Infinite values become the largest double; rows with a missing value drop out."""
    present = [c for c in columns if c in metrics.columns]
    doubles = {f.name for f in metrics.schema.fields if f.dataType.simpleString() == "double"}
    out = [cap_infinite(c).alias(c) if c in present and c in doubles else F.col(c) for c in metrics.columns]
    return metrics.select(*out).na.drop(subset=present)


def column_summary(metrics: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Means of rates, scores and thresholds, sums of counts."""
    means = [c for c in ("process_time", "detection_rate", "median_score", "median_threshold") if c in metrics.columns]
    return clean_metrics(metrics).groupBy(*by).agg(
        *[F.avg(c).alias(c) for c in means],
        F.sum("pos_count").alias("pos_count"),
        F.sum("batch_size").alias("batch_size"),
    )


def is_benign(file: str = "file"):
    return F.col(file).startswith("benign")


def is_attack(file: str = "file"):
    return F.col(file).startswith("attack") | F.col(file).startswith("malicious")


def average_precision(ranked: DataFrame, *, by: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """Average precision per group: sum over distinct scores, best first, of recall gained times precision.

    Ties collapse to one row per score before the shuffle; the running counts are balanced over tasks.
    """
    by = list(by)
    ties = ranked.groupBy(*by, F.col(score).alias("_s")).agg(
        F.sum(label).alias("_p"), F.count("*").alias("_n")
    )
    steps = running_totals(ties, ["_p", "_n"], [F.desc("_s")], stream=by)
    # Without positives the precision is 0 at every recall.
    gained = F.sum(F.col("_p") * F.col("_p_upto") / F.col("_n_upto"))
    return steps.groupBy(*by).agg(F.coalesce(F.try_divide(gained, F.sum("_p")), F.lit(0.0)).alias("ap"))


def detection_summary(
    metrics: DataFrame, *, by: Sequence[str] = (), positive: str = "benign", score: str = "median_score"
) -> DataFrame:
    """Pooled, macro and row-weighted average precision of the batch scores.

    Every attack file is ranked against all benign batches; the pooled form ranks all at once. ``positive``
    names the class with label 1: ``benign`` as in the published tool, or ``attack``.
    """
    by = list(by)
    label = is_benign() if positive == "benign" else is_attack()
    rows = metrics.where(is_benign() | is_attack()).select(
        *by, "file", F.col(score).alias("score"), label.cast("int").alias("label"), is_benign().alias("_benign")
    )
    attacks = rows.where(~F.col("_benign"))
    # One row per parameter set: the attack files of a data set are a short, registered list.
    files = attacks.groupBy(*by, F.lit(0).alias("_one")).agg(F.collect_set("file").alias("_files"))
    if not by:
        files = F.broadcast(files)  # one row
    keyed = rows.where("_benign").withColumn("_one", F.lit(0)).join(files, on=[*by, "_one"])
    against = keyed.select(*by, F.explode(F.concat("_files", F.array(F.lit("*")))).alias("pair"), "score", "label")
    own = attacks.select(*by, F.explode(F.array("file", F.lit("*"))).alias("pair"), "score", "label")
    ranked = against.unionByName(own)
    aps = average_precision(ranked, by=[*by, "pair"])
    weights = attacks.groupBy(*by, F.col("file").alias("pair")).agg(F.count("*").alias("_w"))
    joined = aps.join(weights, on=[*by, "pair"], how="left")
    single = F.col("pair") != "*"
    return joined.groupBy(*by).agg(
        F.max(F.when(~single, F.col("ap"))).alias("pooled_ap"),
        F.avg(F.when(single, F.col("ap"))).alias("macro_ap"),
        F.try_divide(F.sum(F.when(single, F.col("ap") * F.col("_w"))), F.sum(F.when(single, F.col("_w")))).alias("weighted_ap"),
    )


def file_accuracy(metrics: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows judged right per file, null without scores; a file that is neither benign nor attack is an error."""
    rate = F.try_divide(F.sum("pos_count"), F.sum("batch_size"))
    found = metrics.groupBy(*by, "file").agg(rate.alias("_rate"))
    return found.select(
        *by,
        "file",
        F.when(is_benign(), 1 - F.col("_rate"))
        .when(is_attack(), F.col("_rate"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown file type: "), F.col("file"))).cast("double"))
        .alias("accuracy"),
    )


def run_statistics(metrics: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Counts, F1 and accuracies of benign and attack rows in one aggregation; batches without scores have no accuracy."""
    benign, attack = is_benign(), F.col("file").startswith("attack")
    accuracy = F.try_divide("pos_count", "batch_size")
    found = metrics.groupBy(*by).agg(
        F.sum(F.when(benign, F.col("pos_count"))).alias("pos_benign"),
        F.sum(F.when(benign, F.col("batch_size"))).alias("total_benign"),
        F.sum(F.when(attack, F.col("pos_count"))).alias("pos_malicious"),
        F.sum(F.when(attack, F.col("batch_size"))).alias("total_malicious"),
        F.avg(F.when(benign, 1 - accuracy)).alias("acc_benign"),
        F.avg(F.when(attack, accuracy)).alias("acc_malicious"),
    )
    c = F.col
    # Hits count twice against all alarms and all attacks; the accuracies meet in their harmonic mean.
    return found.withColumn(
        "f1", ratio_or(2 * c("pos_malicious"), c("pos_malicious") + c("total_malicious") + c("pos_benign"), 0.0)
    ).withColumn("hmean_acc", ratio_or(2 * c("acc_benign") * c("acc_malicious"), c("acc_benign") + c("acc_malicious"), 0.0))


def parameter_sets(spec: Mapping[str, object]) -> list[dict[str, object]]:
    """All combinations of the list-valued entries; other entries stay fixed."""
    listed = {k: v for k, v in spec.items() if isinstance(v, list)}
    fixed = {k: v for k, v in spec.items() if not isinstance(v, list)}
    return [{**fixed, **dict(zip(listed, combo, strict=True))} for combo in product(*listed.values())]


def drawn_parameter_sets(spec: Mapping[str, Mapping], trials: int, *, seed: int = 42) -> list[dict[str, object]]:
    """Seeded random draws: ``float`` (optionally ``log``), ``int`` and ``categorical`` entries."""
    import numpy as np

    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(trials):
        one: dict[str, object] = {}
        for name, s in spec.items():
            if s["type"] == "float":
                low, high = float(s["low"]), float(s["high"])
                if s.get("log"):
                    one[name] = float(np.exp(rng.uniform(np.log(low), np.log(high))))
                else:
                    one[name] = float(rng.uniform(low, high))
            elif s["type"] == "int":
                one[name] = int(rng.integers(int(s["low"]), int(s["high"]) + 1))
            elif s["type"] == "categorical":
                one[name] = s["choices"][int(rng.integers(len(s["choices"])))]
            else:
                raise ValueError(f"unsupported type {s['type']}")
        sets.append(one)
    return sets


def with_parameters(df: DataFrame, sets: Sequence[Mapping[str, object]]) -> DataFrame:
    """Every row once per parameter set, with ``param_id`` and the set's values."""
    structs = [
        F.struct(F.lit(i).alias("param_id"), *[F.lit(v).alias(k) for k, v in one.items()]) for i, one in enumerate(sets)
    ]
    return df.select("*", F.explode(F.array(*structs)).alias("_p")).select(*df.columns, "_p.*")


def best_parameters(summaries: DataFrame) -> DataFrame:
    """The parameter set with the highest sum of the three average precisions (ties: the first set)."""
    objective = F.col("pooled_ap") + F.col("macro_ap") + F.col("weighted_ap")
    scored = summaries.withColumn("objective", objective)
    best = F.max_by(F.struct(*scored.columns), F.struct(F.round("objective", 12), -F.col("param_id")))
    return scored.agg(best.alias("b")).select("b.*")


def score_bands(metrics: DataFrame, time: str = "t", *, seconds_per_unit: float = 1.0) -> DataFrame:
    """The series behind a score chart: range, quartiles, median and threshold over time."""
    return metrics.select(
        F.timestamp_seconds(F.col(time) * F.lit(seconds_per_unit)).alias("time"),
        "soft_min_score",
        "lower_quartile_score",
        "median_score",
        "upper_quartile_score",
        "soft_max_score",
        "median_threshold",
    ).orderBy("time")


def table_difference(left: DataFrame, right: DataFrame, *, digits: int = 9) -> DataFrame:
    """Rows found in only one of two tables, with doubles compared at ``digits`` decimals."""

    def even(df: DataFrame) -> DataFrame:
        return df.select(
            *[
                F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name)
                for f in left.schema.fields
            ]
        )

    a, b = even(left), even(right)
    only_left = a.exceptAll(b).withColumn("side", F.lit("left"))
    return only_left.unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))

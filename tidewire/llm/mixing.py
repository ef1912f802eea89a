"""Mixing sources to target weights: capped water-filling, then seeded repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.text import word_count
from tidewire.operators.index import row_index
from tidewire.session import settle

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
DIGITS = 3  # hex digits of a bucket: 4096 buckets per source


def source_key(source: Column) -> Column:
    """A key that is never null, so that a missing source is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def place_key(doc_id: Column, seed: str) -> Column:
    """A seeded place of a document inside its source; the id breaks ties."""
    name = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), F.lit("-"), name)


def water_fill(sources: DataFrame, total: int, max_epochs: int) -> DataFrame:
    """Targets of the sources (columns ``source_size``, ``weight``): shares by weight, none above its cap.

    Each round clamps the sources whose share exceeds ``max_epochs`` times their size and deals what is left
    to the others by weight. The level only rises, so a clamped source stays clamped, and every round but
    the last clamps one more. The driver sees two sums per round.
    """
    cap = F.col("source_size") * max_epochs
    level = 0.0
    clamped = -1
    while True:
        # What is clamped at this level, and the weight of the rest.
        over = F.col("weight") * F.lit(level) > cap
        row = sources.agg(
            F.sum(F.when(over, cap).otherwise(0)).alias("caps"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("rest"),
            F.sum(F.when(over, 1).otherwise(0)).alias("n"),
        ).first()
        if row["n"] is None or not row["rest"] or row["n"] == clamped:
            break
        clamped = row["n"]
        level = (total - row["caps"]) / row["rest"]
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), cap.cast("double")))


def plan(sized: DataFrame, *, share: float, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """One row per source: size, target, whole repetitions, and the last place that gets one more.

    ``sized`` has _source (never null), _rank_source, _place and size.
    """
    sources = sized.groupBy("_source", "_name").agg(F.sum("size").alias("source_size"))
    numbered = row_index(sources.withColumn("_last", F.col("_name").isNull()), ["_last", "_name"], name="_rank")
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = settle(
        numbered.select("_source", "source_size", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int")).alias("weight"))
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    goals = water_fill(weighed, round(share * total), max_epochs).select(
        "_source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("whole"),
    ).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    # The words that are left go to the documents in seeded order. Bucket totals find the bucket in which
    # the goal lies; only that bucket's rows are then ordered.
    bucket = F.substring("_place", 1, DIGITS)
    sums = sized.groupBy("_source", bucket.alias("_bucket")).agg(F.sum("size").alias("_sum"), F.max("_place").alias("_top"))
    ordered = Window.partitionBy("_source").orderBy("_bucket")
    buckets = (
        sums.withColumn("_upto", F.sum("_sum").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .join(goals.select("_source", "need"), "_source")
        .withColumn("_from", F.col("_upto") - F.col("_sum"))
    )
    full = buckets.where("need > 0 AND _upto <= need").groupBy("_source").agg(F.max("_top").alias("_cut"))
    edge = buckets.where("_from < need AND _upto > need").select("_source", "_bucket", "_from", "need")
    inside = Window.partitionBy("_source", "_bucket").orderBy("_place")
    taken = (
        sized.withColumn("_bucket", bucket)
        .join(edge, ["_source", "_bucket"])
        .withColumn("_before", F.col("_from") + F.sum("size").over(inside) - F.col("size"))
        # A document is taken if that brings the words nearer to the goal.
        .where("2 * (need - _before) >= size")
        .groupBy("_source")
        .agg(F.max("_place").alias("_cut"))
    )
    cuts = full.unionByName(taken).groupBy("_source").agg(F.max("_cut").alias("_cut"))
    return settle(goals.join(cuts, "_source", "left").select("_source", "source_size", "target", "whole", F.coalesce("_cut", F.lit("")).alias("_cut")))


def copies(
    docs: DataFrame, *, share: float = 1.0, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED
) -> DataFrame:
    """All rows as ``row`` (the whole input row) with size, source_size, target and copies.

    Sizes are words (null: 0). Sources, in the order of their code points with null last, weigh ``weights``
    in turn. A source that is wanted less than once gives whole documents in seeded order until the
    words are as near to the target as whole documents allow; beyond one, every document is repeated, and the
    same order says which get one more. Rows that repeat a doc_id share a place: they are taken
    together. An empty table gives an empty result; sources without words have target 0. Input columns keep
    their names inside ``row`` and cannot clash.
    """
    keyed = docs.select(
        F.struct("*").alias("row"),
        source_key(F.col("source")).alias("_source"),
        place_key(F.col("doc_id"), seed).alias("_place"),
        word_count(F.col("text")).alias("size"),
    )
    sized = settle(keyed.select("_source", F.col("row.source").cast("string").alias("_name"), "_place", "size"))
    goals = plan(sized, share=share, weights=weights, max_epochs=max_epochs)
    return keyed.join(goals, "_source").select(
        "row", "size", "source_size", "target", (F.col("whole") + (F.col("_place") <= F.col("_cut")).cast("long")).alias("copies")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the input's columns, each row as often as the mix takes it."""
    drawn = copies(docs, **options).where("copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).select("row.*")

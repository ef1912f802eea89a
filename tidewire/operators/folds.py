"""Order-dependent state over long streams in bounded pieces."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.session import settle


def chunked_fold(
    rows: DataFrame,
    step: Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame]],
    out_schema: T.StructType,
    *,
    stream: Sequence[str],
    order: Sequence[str],
    chunk: str,
    initial: Callable[[], object],
    guess: Callable[[int], object] | None = None,
    speculate: bool = True,
    pack: Callable[[object], object] = lambda state: state,
    unpack: Callable[[object], object] = lambda plain: plain,
) -> DataFrame:
    """Fold ``step(state, rows) -> (state, output)`` over each stream, exactly as if done in one go.

    ``chunk`` numbers pieces of a stream in order (gaps are fine) and bounds what one task holds. A stream's
    first piece starts from ``initial()``. Speculatively all pieces run at once, the others from
    ``guess(chunk)``; pieces whose real entry state (the exit state of the piece before) turns out different
    run again, until nothing changes. A state that forgets its start, such as a bounded queue, settles after
    a round or two. Without ``speculate`` the pieces of a stream run one round after the other, all streams
    side by side.

    States are stored as bytes in a checkpointed table of one row per piece; ``pack`` turns a state into
    plain values (numbers, arrays, containers) and ``unpack`` back.
    """
    stream = list(stream)
    keys = [*stream, chunk]
    # Folds cost time, not bytes: keep the configured parallelism where sizes alone would merge tasks.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = out_schema.fieldNames()
    rows = settle(rows)  # every round reads it: without this a round would do again all that leads to it

    def run(left: pd.DataFrame, right: pd.DataFrame, *, emit: bool) -> pd.DataFrame:
        if len(right) == 0 or len(left) == 0:
            return pd.DataFrame({c: [] for c in (names if emit else [*keys, "exit"])})
        state = unpack(pickle.loads(right["entry"].iloc[0]))
        state, out = step(state, left.sort_values(list(order), kind="stable"))
        if emit:
            return out[names]
        return pd.DataFrame({**{k: [left[k].iloc[0]] for k in keys}, "exit": [pickle.dumps(pack(state), protocol=5)]})

    key_fields = [rows.schema[k] for k in keys]
    exit_schema = T.StructType([*key_fields, T.StructField("exit", T.BinaryType())])

    def exits_of(entries: DataFrame) -> DataFrame:
        wanted = rows.join(entries.select(*keys), on=keys, how="left_semi")

        def piece(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return run(left, right, emit=False)

        return wanted.repartition(tasks, *keys).groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInPandas(piece, exit_schema)

    by_stream = Window.partitionBy(*stream).orderBy(chunk)
    pieces = settle(
        rows.select(*keys)
        .distinct()
        .withColumn("_next", F.lead(chunk).over(by_stream))
        .withColumn("_first", F.row_number().over(by_stream) == 1)
    )

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            states = [
                initial() if first or guess is None else guess(int(c))
                for first, c in zip(batch["_first"], batch[chunk], strict=True)
            ]
            yield batch[keys].assign(entry=[pickle.dumps(pack(state), protocol=5) for state in states])

    entry_schema = T.StructType([*key_fields, T.StructField("entry", T.BinaryType())])
    begun = pieces if speculate else pieces.where("_first")
    entries = settle(begun.select(*keys, "_first").mapInPandas(start, entry_schema))
    pending = entries
    follows = pieces.where("_next IS NOT NULL").select(*keys, "_next")
    while True:
        exits = exits_of(pending)
        changed = settle(
            exits.join(follows, on=keys).select(*stream, F.col("_next").alias(chunk), F.col("exit").alias("entry"))
        )
        if speculate:
            known = entries.select(*keys, F.col("entry").alias("_used"))
            changed = changed.join(known, on=keys).where("entry <> _used").drop("_used")
        pending = settle(changed)
        if pending.isEmpty():
            break
        entries = settle(entries.join(pending.select(*keys), on=keys, how="left_anti").unionByName(pending))

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return run(left, right, emit=True)

    return rows.repartition(tasks, *keys).groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInPandas(finish, out_schema)

"""Exponentially decayed sums as window sums.

For one key the wanted value after row ``i`` is ``sum_j v_j * 2**(-rate * (t_i - t_j))`` over the rows
``j`` up to ``i``. Written with a growing factor ``g = 2**(rate * (t - start))`` relative to a slice start
this is ``(prefix sum of v*g within the slice + state carried into the slice) / g``, so no row-by-row
state is needed.

A slice is (key, block of ``chunk_rows`` consecutive arrival numbers, time bucket). The arrival block bounds
the rows of one window group whatever the skew of keys or timestamps; the time bucket keeps ``g`` below
``2**bits``, far from overflow (the relative precision of a double does not depend on its exponent, so a
large ``bits`` costs nothing). Contributions older than ``carry_buckets`` buckets are below ``2**-bits``. The state carried into each slice comes from a second, small pass over one row per slice.

Values and keys are SQL expression strings: the plans are wide, and one string costs one call to the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.columns import decay_tag
from tidewire.schema import DECAY_RATES


@dataclass(frozen=True)
class Term:
    """One decayed sum: output name, decay rate and the SQL value added per row.

    ``power`` states how the term depends on the gap to the previous row (0: not at all) where the
    value is such a gap.
    """

    name: str
    rate: float
    value: str = "1D"
    power: int = 0


def statistic_terms(value: str, rates: Sequence[float] = DECAY_RATES) -> list[Term]:
    """Weight, sum and square sum of ``value`` for every rate."""
    terms = []
    for rate in rates:
        tag = decay_tag(rate)
        terms += [
            Term(f"w_{tag}", rate, "1D", 0),
            Term(f"s_{tag}", rate, value, 1),
            Term(f"ss_{tag}", rate, f"({value}) * ({value})", 2),
        ]
    return terms


def decayed_sums(
    events: DataFrame,
    keys: Sequence[str],
    terms: Sequence[Term],
    *,
    time: str = "t",
    order: Sequence[str] = ("_arrival",),
    arrival: str = "_arrival",
    gap_where: str | None = None,
    first_is_zero: bool = False,
    bits: int = 400,
    carry_buckets: int = 1,
    chunk_rows: int = 1 << 20,
    rows: int | None = None,
) -> DataFrame:
    """Add one decayed sum per term to ``events``.

    keys           columns of the statistic's key (never null).
    order          row order inside a key; ``arrival`` (see ``index.arrival``) must grow with it and with time.
    gap_where      SQL condition of the rows whose value is the time since the key's previous row (0 for
                   the first row); their terms take ``gap ** power`` in place of ``value``.
    first_is_zero  the first row of a key adds nothing.
    rows           number of rows of ``events``, if known: then tasks grow in number with it (``task_count``).
    """
    keys = list(keys)
    rates = sorted({term.rate for term in terms})
    width = bits / rates[-1]
    slice_keys = [*keys, "_chunk", "_bucket"]
    group = ", ".join(slice_keys)
    ordering = ", ".join(order)
    in_slice = f"PARTITION BY {group} ORDER BY {ordering}"

    tasks = task_count(events, rows)
    rows = events.selectExpr(
        "*",
        f"floor({arrival} / {chunk_rows}) AS _chunk",
        f"floor({time} / {width!r}D) AS _bucket",
    ).selectExpr("*", f"_bucket * {width!r}D AS _start")
    if tasks:
        rows = rows.repartition(tasks, *slice_keys)
    if gap_where:
        rows = rows.selectExpr(
            "*", f"({gap_where}) AS _is_gap", f"{time} - lag({time}) OVER ({in_slice}) AS _gap0"
        ).selectExpr("*", "coalesce(_gap0, 0D) AS _gap")

    def growth(rate: float, at: str = time) -> str:
        return f"pow(2D, {rate!r}D * ({at} - _start))"

    def value(term: Term) -> str:
        if not gap_where:
            return f"({term.value})"
        powered = {0: "1D", 1: "_gap", 2: "_gap * _gap"}[term.power]
        return f"(CASE WHEN _is_gap THEN {powered} ELSE {term.value} END)"

    def grown(term: Term) -> str:
        return f"{value(term)} * {growth(term.rate)}"

    running = f"({in_slice} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    local = rows.selectExpr("*", *[f"sum({grown(term)}) OVER {running} AS _p_{term.name}" for term in terms])

    # One row per slice.
    rank = f"struct({ordering})"
    sliced = [f"min({time}) AS _first", f"max({time}) AS _last", "first(_start) AS _start"]
    sliced += [f"sum({grown(term)}) AS _s_{term.name}" for term in terms]
    if gap_where:
        sliced.append("first(_is_gap) AS _is_gap")
    if first_is_zero:
        sliced += [f"min_by({term.value}, {rank}) AS _f_{term.name}" for term in terms]
    slices = rows.groupBy(*slice_keys).agg(*[F.expr(text) for text in sliced])
    if tasks:
        slices = slices.repartition(tasks, *keys)
    carried = _carried(slices, keys, terms, growth, bool(gap_where), first_is_zero, bits, carry_buckets)

    joined = local.join(carried, on=slice_keys, how="left")
    return joined.selectExpr(
        *[f"`{name}`" for name in events.columns],
        *[
            f"(_p_{term.name} + coalesce(_c_{term.name}, 0D)) / {growth(term.rate)} AS {term.name}"
            for term in terms
        ],
    )


TASK_ROWS = 1 << 17  # rows of a task: the windows over wide rows take about 4 KB of its memory for each


def task_count(events: DataFrame, rows: int | None) -> int | None:
    """Shuffle partitions that leave a task TASK_ROWS rows, or None where as many as there are cores do so.

    Adaptive execution merges partitions until there is one per core, so what a task holds would grow with the data.
    """
    tasks = -(-(rows or 0) // TASK_ROWS)
    return tasks if tasks > events.sparkSession.sparkContext.defaultParallelism else None


def _carried(slices, keys, terms, growth, gaps, first_is_zero, bits, carry_buckets) -> DataFrame:
    """What has to be added to the prefix sums of each slice."""
    group = ", ".join(keys)
    by_key = f"(PARTITION BY {group} ORDER BY _chunk, _bucket)"
    # The first row of a slice may depend on what came before the slice. That correction counts for the
    # slice itself and, through the slice's total, for every later one.
    fix = {term.name: "0D" for term in terms}
    if gaps:
        slices = slices.selectExpr(
            "*", f"CASE WHEN _is_gap THEN coalesce(_first - lag(_last) OVER {by_key}, 0D) ELSE 0D END AS _gap"
        )
        for term in terms:
            if term.power:
                powered = "_gap" if term.power == 1 else "_gap * _gap"
                fix[term.name] = f"{powered} * {growth(term.rate, '_first')}"
    if first_is_zero:
        slices = slices.selectExpr("*", f"row_number() OVER {by_key} = 1 AS _opens")
        for term in terms:
            fix[term.name] = f"CASE WHEN _opens THEN -_f_{term.name} * {growth(term.rate, '_first')} ELSE 0D END"
    slices = slices.selectExpr(
        *keys,
        "_chunk",
        "_bucket",
        "_start",
        *[f"{fix[term.name]} AS _x_{term.name}" for term in terms],
        *[f"_s_{term.name} + {fix[term.name]} AS _s_{term.name}" for term in terms],
    )
    for rate in sorted({term.rate for term in terms}):
        mine = [term.name for term in terms if term.rate == rate]
        length = bits / rate
        slices = slices.selectExpr("*", f"floor(_start / {length!r}D) AS _coarse").selectExpr(
            "*", f"pow(2D, {rate!r}D * (_start - _coarse * {length!r}D)) AS _lift"
        )
        earlier = f"(PARTITION BY {group}, _coarse ORDER BY _chunk, _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        sums = [f"sum(_s_{name} * _lift) OVER {earlier} AS _e0_{name}" for name in mine]
        for o in range(1, carry_buckets + 1):
            frame = f"(PARTITION BY {group} ORDER BY _coarse RANGE BETWEEN {o} PRECEDING AND {o} PRECEDING)"
            sums += [f"sum(_s_{name} * _lift) OVER {frame} AS _e{o}_{name}" for name in mine]
        slices = slices.selectExpr("*", *sums)
        carries = []
        for name in mine:
            parts = [f"coalesce(_e0_{name}, 0D)"]
            parts += [f"coalesce(_e{o}_{name}, 0D) * {2.0 ** (-bits * o)!r}D" for o in range(1, carry_buckets + 1)]
            carries.append(f"({' + '.join(parts)}) / _lift + _x_{name} AS _c_{name}")
        kept = [c for c in slices.columns if not c.startswith("_e") and c not in ("_coarse", "_lift")]
        slices = slices.selectExpr(*kept, *carries)
    return slices.selectExpr(*keys, "_chunk", "_bucket", *[f"_c_{term.name}" for term in terms])

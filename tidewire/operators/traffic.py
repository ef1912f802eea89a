"""Per-packet traffic statistics: one-sided, gap based and two-sided (link) forms.

Keys and values are SQL expression strings over the packet columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import columns as C
from tidewire.operators.decay import Term, decayed_sums, statistic_terms, task_count
from tidewire.operators.index import arrival, running_totals
from tidewire.operators.visits import HOME_ROWS, Layout, home_statistics
from tidewire.schema import DECAY_RATES, PROTOCOL_IDS, WEIGHT_FLOOR

STATS_1D = ("weight", "mean", "std")
STATS_2D = ("magnitude", "radius", "covariance", "pcc")

# Composite keys of the statistics.
KEYS = {
    "mac_ip": "concat_ws('_', src_mac, src_ip)",
    "ip_pair": "concat_ws('_', src_ip, dst_ip)",
    "src_ip": "src_ip",
    "dst_ip": "dst_ip",
    "src_socket": "concat_ws('_', src_ip, src_port)",
    "dst_socket": "concat_ws('_', dst_ip, dst_port)",
}


@dataclass(frozen=True)
class Single:
    """A keyed statistic; without a value it measures the gap between the key's rows."""

    name: str
    key: str
    value: str | None


@dataclass(frozen=True)
class Pair:
    """A two-sided statistic: the source endpoint receives ``+value``, then the destination ``-value``."""

    name: str
    src: str
    dst: str
    value: str


def layer_id_sql(protocol: str = "protocol", ids: dict[str, int] | None = None) -> str:
    """Layer number of a protocol label; unknown labels take the last number."""
    ids = ids or PROTOCOL_IDS
    branches = " ".join(f"WHEN '{label}' THEN {number}" for label, number in ids.items())
    return f"CASE {protocol} {branches} ELSE {len(ids) - 1} END"


def statistics(
    packets: DataFrame,
    singles: Sequence[Single] = (),
    pairs: Sequence[Pair] = (),
    *,
    rates: Sequence[float] = DECAY_RATES,
    keep: Sequence[str] = ("t",),
    stream: Sequence[str] = (),
    joint: bool = True,
    far: bool = True,
    homes: tuple[str, str] | None = None,
    marks: Sequence[str] = (),
    **options,
) -> DataFrame:
    """One row per packet with all requested statistics, by ``stream`` columns and ``seq``.

    ``homes`` are the endpoints (source, destination) that the keys are made of. Where no home holds a separator of the keys (``marks``),
    every key lies in one home and the statistics are computed there (``visits``), which shuffles short rows and, once, the
    destinations' statistics; a missing endpoint is a home of its own. Otherwise, and for keys of other kinds, statistics are dealt by key:

    Every packet contributes one row per single and two per pair to one key-event table; the sums of all
    statistics come from one windowed pass, the link covariances from a second one. Both endpoint states
    of a packet meet again by one shuffle on its place in time, which the covariance pass and the result share.
    Without ``joint`` that second pass and its columns (covariance, pcc) are left out. Each ``stream`` (a capture file) has its own packet numbers and statistics. ``keep`` columns pass through.
    Without ``far`` the destination's weight, mean and deviation may be left out.
    """
    if homes is None and len(pairs) == 1 and not singles:
        homes = pairs[0].src, pairs[0].dst
    texts = " ".join([*[f"{s.key} {s.value}" for s in singles], *[f"{p.src} {p.dst} {p.value}" for p in pairs], *(homes or ())]).lower()
    passed = {*stream, "seq", "t", "_arrival", *keep}
    packets = arrival(packets.select(*[c for c in packets.columns if c in passed or c.lower() in texts]), stream, stored=True)
    if homes is not None and pairs:
        marked = [f"instr(cast({home} AS string), '{mark}') > 0" for home in homes for mark in (*marks, "->")]
        unfit = f"coalesce(bool_or({' OR '.join(marked)}), false)"
        count, mixed = packets.agg(F.count("*"), F.expr(unfit)).first()
        if not mixed:
            return _at_homes(packets, count, singles, pairs, rates, keep, stream, joint, far, homes, **options)
    else:
        count = packets.count()
    slots: list[tuple[int, str, str]] = []
    for number, single in enumerate(singles):
        slots.append((number, single.key, single.value or "0D"))
    for number, pair in enumerate(pairs, start=len(singles)):
        slots.append((number, pair.src, pair.value))
        slots.append((number, pair.dst, f"-({pair.value})"))
    gap_kinds = [str(number) for number, single in enumerate(singles) if single.value is None]
    tags = [C.decay_tag(rate) for rate in rates]
    row_id = [*stream, "_arrival"]
    shown = [*stream, "seq"]

    entries = ", ".join(
        f"named_struct('slot', {slot}, 'kind', {kind}, 'key', cast({key} AS string), 'v', cast({value} AS double))"
        for slot, (kind, key, value) in enumerate(slots)
    )
    events = packets.selectExpr(*row_id, "t", f"explode(array({entries})) AS e").selectExpr(*row_id, "t", "e.*")
    sums = decayed_sums(
        events,
        [*stream, "kind", "key"],
        statistic_terms("v", rates),
        order=("_arrival", "slot"),
        gap_where=f"kind IN ({', '.join(gap_kinds)})" if gap_kinds else None,
        rows=count * len(slots),
        **options,
    )
    # One array per event (weights, means, variances) keeps the code of the pivot small.
    weights = [f"w_{tag}" for tag in tags]
    means = [C.mean_sql(f"w_{tag}", f"s_{tag}") for tag in tags]
    variances = [C.var_sql(f"w_{tag}", f"s_{tag}", f"ss_{tag}") for tag in tags]
    state = sums.selectExpr(*row_id, "slot", f"array({', '.join(weights + means + variances)}) AS a")
    # Shuffle the narrow rows first: aggregating before the exchange would only widen them.
    tasks = task_count(packets, count * len(slots))
    placed = [tasks, *row_id] if tasks else row_id
    pivot = (
        state.repartition(*placed)
        .groupBy(*row_id)
        .agg(*[F.expr(f"first(CASE WHEN slot = {slot} THEN a END, true) AS a{slot}") for slot in range(len(slots))])
    )
    offset = {"w": 0, "m": len(tags), "q": 2 * len(tags)}

    def at(slot: int, part: str, tag: str) -> str:
        return f"a{slot}[{offset[part] + tags.index(tag)}]"

    def one_sided(name: str, slot: int) -> list[str]:
        return [
            text
            for tag in tags
            for text in (
                f"{at(slot, 'w', tag)} AS {name}_{tag}_weight",
                f"{at(slot, 'm', tag)} AS {name}_{tag}_mean",
                f"sqrt({at(slot, 'q', tag)}) AS {name}_{tag}_std",
            )
        ]

    kept = [name for name in keep if name not in shown]
    facts = packets.selectExpr(
        *row_id,
        *dict.fromkeys(["seq", "t", *kept]),
        *[
            text
            for number, pair in enumerate(pairs)
            for text in (
                f"cast({pair.src} AS string) AS _src{number}",
                f"cast({pair.dst} AS string) AS _dst{number}",
                f"cast({pair.value} AS double) AS _val{number}",
            )
        ],
    )
    # Both sides have one row per packet and are placed alike: never worth a broadcast.
    wide = pivot.hint("merge").join(facts, on=row_id)
    singles_out = [text for number, single in enumerate(singles) for text in one_sided(single.name, number)]
    if not pairs:
        return wide.selectExpr(*shown, *kept, *singles_out)

    def endpoint(number: int, part: str, tag: str) -> str:
        """The source state the covariance sees: after both updates, so a packet to itself reads the second."""
        first = len(singles) + 2 * number
        return f"(CASE WHEN _src{number} = _dst{number} THEN {at(first + 1, part, tag)} ELSE {at(first, part, tag)} END)"

    def two_sided(number: int, pair: Pair) -> list[str]:
        first = len(singles) + 2 * number
        second = first + 1
        out = one_sided(pair.name, first) + one_sided(f"{pair.name}_dst", second)
        for tag in tags:
            ends = endpoint(number, "m", tag), at(second, "m", tag)
            spreads = endpoint(number, "q", tag), at(second, "q", tag)
            out += [
                f"{C.magnitude_sql(*ends)} AS {pair.name}_{tag}_magnitude",
                f"{C.magnitude_sql(*spreads)} AS {pair.name}_{tag}_radius",
            ]
        return out

    pair_out = [text for number, pair in enumerate(pairs) for text in two_sided(number, pair)]
    if not joint:
        return wide.selectExpr(*shown, *kept, *singles_out, *pair_out)
    links = []
    for number in range(len(pairs)):
        second = len(singles) + 2 * number + 1
        fields = [f"'pair', {number}", f"'link', concat_ws('->', _src{number}, _dst{number})"]
        for tag in tags:
            value = f"_val{number}"
            fields += [
                f"'r_{tag}', ({value} - {endpoint(number, 'm', tag)}) * ({value} - {at(second, 'm', tag)})",
                f"'total_{tag}', {endpoint(number, 'w', tag)} + {at(second, 'w', tag)}",
                f"'spread_{tag}', sqrt({endpoint(number, 'q', tag)}) * sqrt({at(second, 'q', tag)})",
            ]
        links.append(f"named_struct({', '.join(fields)})")
    link_rows = wide.selectExpr(*row_id, "t", f"explode(array({', '.join(links)})) AS l").selectExpr(
        *row_id, "t", "l.*"
    )
    residuals = decayed_sums(
        link_rows,
        [*stream, "pair", "link"],
        [Term(f"sr_{tag}", rate, f"r_{tag}") for tag, rate in zip(tags, rates, strict=True)],
        first_is_zero=True,
        rows=count * len(pairs),
        **options,
    )
    covariances = residuals.selectExpr(
        *row_id,
        "pair",
        *[f"{C.covariance_sql(f'sr_{tag}', f'total_{tag}')} AS cov_{tag}" for tag in tags],
        *[f"spread_{tag}" for tag in tags],
    )
    both = [f"cov_{tag}" for tag in tags] + [C.correlation_sql(f"cov_{tag}", f"spread_{tag}") for tag in tags]
    by_packet = (
        covariances.selectExpr(*row_id, "pair", f"array({', '.join(both)}) AS c")
        .repartition(*placed)
        .groupBy(*row_id)
        .agg(*[F.expr(f"first(CASE WHEN pair = {number} THEN c END, true) AS c{number}") for number in range(len(pairs))])
    )
    for number, pair in enumerate(pairs):
        for place, tag in enumerate(tags):
            pair_out += [
                f"c{number}[{place}] AS {pair.name}_{tag}_covariance",
                f"c{number}[{len(tags) + place}] AS {pair.name}_{tag}_pcc",
            ]
    return wide.hint("merge").join(by_packet, on=row_id).selectExpr(*shown, *kept, *singles_out, *pair_out)


def _at_homes(packets, count, singles, pairs, rates, keep, stream, joint, far, homes, *, chunk_rows: int = HOME_ROWS, **_) -> DataFrame:
    """The statistics by ``visits.home_statistics``; its sums need no time buckets, so their options do not matter."""
    kinds = [*singles, *pairs]
    values = list(dict.fromkeys(kind.value for kind in kinds if kind.value is not None))
    layout = Layout(
        stream=tuple(stream),
        kept=tuple(name for name in dict.fromkeys(keep) if name not in (*stream, "seq")),
        names=tuple(kind.name for kind in kinds),
        singles=len(singles),
        values=tuple(None if kind.value is None else values.index(kind.value) for kind in kinds),
        rates=tuple(rates),
        joint=joint,
        far=far,
    )
    keys = [*[(single.key, None) for single in singles], *[(pair.src, pair.dst) for pair in pairs]]
    return home_statistics(packets, count, layout, keys, values, homes, chunk_rows)


def capture_stream(packets: DataFrame, stream: Sequence[str] | None) -> list[str]:
    """The columns that tell captures apart: ``file`` where the table has it, unless stated otherwise."""
    return list(stream) if stream is not None else [c for c in ("file",) if c in packets.columns]


def _ordered(names: Sequence[str], stats: Sequence[str], rates: Sequence[float]) -> list[str]:
    return [f"{name}_{C.decay_tag(rate)}_{stat}" for name in names for stat in stats for rate in rates]


def traffic_features(
    packets: DataFrame,
    rates: Sequence[float] = DECAY_RATES,
    *,
    arp_by_mac: bool = False,
    stream: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """The tabular form: ``t`` and 20 statistics per decay rate (100 columns for five rates).

    Every capture file is a stream of its own and its name part of the result; ``stream=()`` reads all as one.

    ``arp_by_mac`` keys the socket statistic of ARP packets by hardware address.
    """
    streams = capture_stream(packets, stream)
    src_socket, dst_socket = KEYS["src_socket"], KEYS["dst_socket"]
    if arp_by_mac:
        src_socket = f"CASE WHEN lower(src_port) = 'arp' THEN src_mac ELSE {src_socket} END"
        dst_socket = f"CASE WHEN lower(src_port) = 'arp' THEN dst_mac ELSE {dst_socket} END"
    wide = statistics(
        packets,
        [Single("src_mac_ip", KEYS["mac_ip"], "packet_size"), Single("jitter", KEYS["ip_pair"], None)],
        [
            Pair("channel", KEYS["src_ip"], KEYS["dst_ip"], "packet_size"),
            Pair("socket", src_socket, dst_socket, "packet_size"),
        ],
        rates=rates,
        stream=streams,
        far=False,
        homes=None if arp_by_mac else (KEYS["src_ip"], KEYS["dst_ip"]),
        marks=("_",),
        **options,
    )
    return wide.select(
        *streams,
        "seq",
        "t",
        *_ordered(("src_mac_ip", "jitter"), STATS_1D, rates),
        *_ordered(("channel", "socket"), STATS_1D + STATS_2D, rates),
    )


def link_features(
    packets: DataFrame,
    rates: Sequence[float] = DECAY_RATES,
    protocol_ids: dict[str, int] | None = None,
    *,
    stream: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """The graph form: endpoint, gap and link statistics per (hardware address, layer), per capture file."""
    streams = capture_stream(packets, stream)
    layered = packets.selectExpr("*", f"{layer_id_sql('protocol', protocol_ids)} AS protocol_id")
    src = "concat_ws('/', src_mac, cast(protocol_id AS string))"
    dst = "concat_ws('/', dst_mac, cast(protocol_id AS string))"
    wide = statistics(
        layered,
        [Single("jitter", f"concat_ws('-', {src}, {dst})", None)],
        [Pair("link", src, dst, "packet_size")],
        rates=rates,
        keep=("t", "src_mac", "dst_mac", "protocol_id"),
        stream=streams,
        homes=(src, dst),
        marks=("-",),
        **options,
    )
    tags = [C.decay_tag(rate) for rate in rates]
    return wide.selectExpr(
        *streams,
        "seq",
        "t",
        "1 AS type",
        "src_mac AS src_id",
        "dst_mac AS dst_id",
        "protocol_id AS protocol",
        *[f"link_{tag}_{stat} AS src_{tag}_{stat}" for stat in STATS_1D for tag in tags],
        *[f"link_dst_{tag}_{stat} AS dst_{tag}_{stat}" for stat in STATS_1D for tag in tags],
        *_ordered(("jitter",), STATS_1D, rates),
        *_ordered(("link",), STATS_2D, rates),
    )


def keyed_statistics(
    packets: DataFrame,
    key: str,
    value: str | None,
    *,
    name: str = "stat",
    rates: Sequence[float] = DECAY_RATES,
    keep: Sequence[str] = ("t",),
    keys: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Weight, mean and deviation of one keyed statistic per packet.

    With a single statistic no packet needs to be put together again, so the result stays where the
    windows left it: one shuffle of the packets besides the numbering. ``keys`` adds further key columns, such as
    the capture file.
    """
    kept = [c for c in dict.fromkeys([*keep, *keys]) if c != "seq"]
    rows = arrival(packets).selectExpr(
        "seq",
        "_arrival",
        *dict.fromkeys(["t", *kept, *keys]),
        f"cast({key} AS string) AS _key",
        f"cast({value or '0D'} AS double) AS _value",
    )
    sums = decayed_sums(
        rows,
        [*keys, "_key"],
        statistic_terms("_value", rates),
        gap_where=None if value else "true",
        rows=rows.count(),
        **options,
    )
    return sums.selectExpr(
        "seq",
        *kept,
        *[
            text
            for tag in map(C.decay_tag, rates)
            for text in (
                f"w_{tag} AS {name}_{tag}_weight",
                f"{C.mean_sql(f'w_{tag}', f's_{tag}')} AS {name}_{tag}_mean",
                f"sqrt({C.var_sql(f'w_{tag}', f's_{tag}', f'ss_{tag}')}) AS {name}_{tag}_std",
            )
        ],
    )


def link_statistics(
    packets: DataFrame,
    src: str,
    dst: str,
    value: str,
    *,
    name: str = "link",
    rates: Sequence[float] = DECAY_RATES,
    **options,
) -> DataFrame:
    """Source and destination statistics with magnitude, radius, covariance and correlation of one link."""
    return statistics(packets, [], [Pair(name, src, dst, value)], rates=rates, **options)


def idle_sessions(
    rows: DataFrame,
    keys: Sequence[str],
    *,
    rates: Sequence[float] = DECAY_RATES,
    stream: Sequence[str] = (),
    floor: float = WEIGHT_FLOOR,
    chunk_rows: int = 1 << 20,
    **options,
) -> DataFrame:
    """Split a key's rows where its statistic died out: the slowest decaying weight fell below ``floor``.

    ``stream`` names the capture, which is numbered on its own and is part of every key. Adds ``weight`` (after the row), ``expires_at`` (when it falls below the floor without new rows) and
    ``session`` (0, 1, ... per key).
    """
    keys = [*stream, *keys]
    slow = min(rates)
    group = ", ".join([*keys, "_chunk"])
    weighed = decayed_sums(arrival(rows, stream), keys, [Term("weight", slow)], chunk_rows=chunk_rows, **options).selectExpr(
        "*", f"t + log2(weight / {floor!r}D) / {slow!r}D AS expires_at", f"floor(_arrival / {chunk_rows}) AS _chunk"
    )
    in_chunk = f"PARTITION BY {group} ORDER BY _arrival"
    flagged = weighed.selectExpr(
        "*", f"CASE WHEN t > lag(expires_at) OVER ({in_chunk}) THEN 1 ELSE 0 END AS _new"
    )
    by_key = f"PARTITION BY {', '.join(keys)} ORDER BY _chunk"
    chunks = (
        flagged.groupBy(*keys, "_chunk")
        .agg(
            F.sum("_new").alias("_n"),
            F.min("t").alias("_first"),
            F.max_by("expires_at", "_arrival").alias("_end"),
        )
        .selectExpr("*", f"CASE WHEN _first > lag(_end) OVER ({by_key}) THEN 1 ELSE 0 END AS _cut")
        .selectExpr(*keys, "_chunk", f"sum(_n + _cut) OVER ({by_key} ROWS UNBOUNDED PRECEDING) - _n AS _base")
    )
    return flagged.join(chunks, on=[*keys, "_chunk"]).selectExpr(
        *rows.columns,
        "weight",
        "expires_at",
        f"cast(_base + sum(_new) OVER ({in_chunk} ROWS UNBOUNDED PRECEDING) AS bigint) AS session",
    )


def statistics_with_expiry(
    packets: DataFrame, key: str, value: str | None, *, rates: Sequence[float] = DECAY_RATES, **options
) -> DataFrame:
    """Keyed statistics that start afresh once they have died out."""
    keyed = arrival(packets).selectExpr("*", f"cast({key} AS string) AS stat_key")
    sessions = idle_sessions(keyed, ["stat_key"], rates=rates, **options).drop("weight", "expires_at")
    return keyed_statistics(
        sessions, "stat_key", value, rates=rates, keep=("t", "stat_key", "session"), keys=("session",), **options
    )


def expired_links(
    packets: DataFrame,
    *,
    rates: Sequence[float] = DECAY_RATES,
    protocol_ids: dict[str, int] | None = None,
    stream: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Delete rows (``type`` 0): one per link and idle session that ended before the last packet of its capture.

    ``t`` is the time the link expired, ``seq`` the first packet after it: a deletion takes effect just before that packet.
    """
    stream = list(stream)
    links = packets.selectExpr(
        *stream, "seq", "t", "src_mac AS src_id", "dst_mac AS dst_id", f"{layer_id_sql('protocol', protocol_ids)} AS protocol"
    )
    keys = [*stream, "src_id", "dst_id", "protocol"]
    numbered = arrival(links, stream)
    ends = (
        idle_sessions(numbered, keys[len(stream) :], rates=rates, stream=stream, **options)
        .groupBy(*keys, "session")
        .agg(F.max("expires_at").alias("t"))
    )
    # As many packets lie up to an expiry as the number of the next one; packets count themselves, expiries come after them.
    place = numbered.select(*stream, "t", F.lit(0).alias("_late"), F.col("_arrival").alias("_tie"), F.lit(1).cast("long").alias("_packets"))
    gone = ends.select(*keys, "session", "t", F.lit(1).alias("_late"), F.xxhash64(*keys, "session").alias("_tie"), F.lit(0).cast("long").alias("_packets"))
    merged = place.unionByName(gone, allowMissingColumns=True)
    counted = running_totals(merged, ["_packets"], ["t", "_late", "_tie"], stream=stream).where("_late = 1")
    after = counted.select(*keys, "session", "t", F.col("_packets_upto").alias("_arrival"))
    return after.join(numbered.select(*stream, "_arrival", "seq"), [*stream, "_arrival"]).select(*stream, "seq", "t", F.lit(0).alias("type"), *keys[len(stream) :], "session")


def peek(
    history: DataFrame,
    candidates: DataFrame,
    key: str,
    value: str,
    *,
    rates: Sequence[float] = DECAY_RATES,
    **options,
) -> DataFrame:
    """Statistics the candidate rows would get, each on its own, without entering the history.

    An as-of lookup: candidates travel through the history's windows with weight 0, which leaves the state
    at their time, and then add their own value.
    """

    def view(df: DataFrame, new: int) -> DataFrame:
        return df.selectExpr(
            "seq", "t", f"cast({key} AS string) AS key", f"cast({value} AS double) AS v", f"{new} AS new"
        )

    rows = view(history, 0).unionByName(view(candidates, 1))
    own = "(CASE WHEN new = 1 THEN 0D ELSE 1D END)"
    terms = []
    for rate in rates:
        tag = C.decay_tag(rate)
        terms += [
            Term(f"w_{tag}", rate, own),
            Term(f"s_{tag}", rate, f"{own} * v"),
            Term(f"ss_{tag}", rate, f"{own} * v * v"),
        ]
    placed = arrival(rows, order=("t", "new", "seq"))
    state = decayed_sums(placed, ["key"], terms, **options).where("new = 1")
    out = []
    for tag in map(C.decay_tag, rates):
        w, s, ss = f"(w_{tag} + 1D)", f"(s_{tag} + v)", f"(ss_{tag} + v * v)"
        out += [
            f"{w} AS stat_{tag}_weight",
            f"{C.mean_sql(w, s)} AS stat_{tag}_mean",
            f"sqrt({C.var_sql(w, s, ss)}) AS stat_{tag}_std",
        ]
    return state.selectExpr("seq", "t", "key", *out)

"""Queries of the decayed statistics, with self-join SQL as the independent check."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions.columns import CANCELLATION, decay_tag
from tidewire.operators import traffic as TR
from tidewire.operators.windows import frequency
from tidewire.plans.registry import query, r, round_stats, rounded
from tidewire.schema import DECAY_RATES, packets

TAGS = [(rate, decay_tag(rate)) for rate in DECAY_RATES]


def _mean(p: str, tag: str) -> str:
    return f"CASE WHEN {p}w_{tag} < 1e-3 THEN 0 ELSE {p}s_{tag} / {p}w_{tag} END"


def _var(p: str, tag: str) -> str:
    w, s, ss = f"{p}w_{tag}", f"{p}s_{tag}", f"{p}ss_{tag}"
    gap = f"abs({ss} / {w} - ({s} / {w}) * ({s} / {w}))"
    return f"CASE WHEN {w} < 1e-3 OR {gap} <= {CANCELLATION!r} * {ss} / {w} THEN 0 ELSE {gap} END"


def sums_sql(source: str, target: str, keys: str, carry: str = "") -> str:
    """CTE ``target``: decayed weight, sum and square sum per row of ``source(pos, t, v, keys)`` by self join."""
    sums = ", ".join(
        f"sum(pow(2, -{rate} * (a.t - b.t))) AS w_{tag}, sum(b.v * pow(2, -{rate} * (a.t - b.t))) AS s_{tag},"
        f" sum(b.v * b.v * pow(2, -{rate} * (a.t - b.t))) AS ss_{tag}"
        for rate, tag in TAGS
    )
    return (
        f"{target} AS (SELECT a.pos, {carry}{sums} FROM {source} a JOIN {source} b USING ({keys})"
        f" WHERE b.pos <= a.pos GROUP BY ALL)"
    )


def stats_cte(source: str, target: str) -> str:
    """CTE ``target``: w/m/q per rate."""
    cols = ", ".join(f"w_{tag}, {_mean('', tag)} AS m_{tag}, {_var('', tag)} AS q_{tag}" for _, tag in TAGS)
    return f"{target} AS (SELECT pos, {cols} FROM {source})"


def single_columns(alias: str, name: str) -> list[str]:
    out = []
    for _, tag in TAGS:
        out += [
            r(f"{alias}.w_{tag}", f"{name}_{tag}_weight", 6),
            r(f"{alias}.m_{tag}", f"{name}_{tag}_mean", 5),
            r(f"sqrt({alias}.q_{tag})", f"{name}_{tag}_std", 3),
        ]
    return out


def keyed_sql(key: str, value: str, name: str = "stat") -> str:
    """One keyed statistic; ``value`` may be the word gap."""
    v = "coalesce(t - lag(t) OVER (PARTITION BY key ORDER BY seq), 0)" if value == "gap" else value
    return f"""WITH {{packets}},
      base AS (SELECT *, {key} AS key FROM packets),
      ev AS (SELECT seq AS pos, t, key, {v} AS v FROM base),
      {sums_sql("ev", "sums", "key", "a.t, ")},
      {stats_cte("sums", "st")}
      SELECT st.pos AS seq, {r("sums.t", "t", 6)}, {", ".join(single_columns("st", name))}
      FROM st JOIN sums USING (pos)"""


@query("decayed_statistics", keyed_sql("src_mac || '_' || src_ip", "packet_size"))
def decayed_statistics(spark, sf):
    df = TR.keyed_statistics(packets(spark, sf), TR.KEYS["mac_ip"], "packet_size")
    return round_stats(df.withColumn("t", F.round("t", 6)))


@query("jitter_statistics", keyed_sql("src_ip || '_' || dst_ip", "gap", "jitter"))
def jitter_statistics(spark, sf):
    df = TR.keyed_statistics(packets(spark, sf), TR.KEYS["ip_pair"], None, name="jitter")
    return round_stats(df.withColumn("t", F.round("t", 6)))


@query("late_packets", keyed_sql("file || src_mac || '_' || src_ip", "packet_size"))
def late_packets(spark, sf):
    """Statistics per capture of packets that arrive in reverse, across many chunks."""
    late = packets(spark, sf).selectExpr("* EXCEPT (seq)", "10000000 - seq AS seq", "seq AS event")
    df = TR.keyed_statistics(late, TR.KEYS["mac_ip"], "packet_size", keys=("file",), keep=("t", "event"), chunk_rows=64)
    return round_stats(df.drop("seq", "file").withColumnRenamed("event", "seq").withColumn("t", F.round("t", 6)))


def wide_sql(singles: list[tuple[str, str, str]], pairs: list[tuple[str, str, str]], layered: bool = False) -> str:
    """CTEs of a full statistics table: ``singles`` (name, key, value|gap), ``pairs`` (name, src, dst)."""
    ctes = ["{packets}"]
    source = "packets"
    if layered:
        ctes.append(
            "layered AS (SELECT *, CASE protocol WHEN 'TCP' THEN 0 WHEN 'UDP' THEN 1 WHEN 'ICMP' THEN 2"
            " WHEN 'ARP' THEN 3 ELSE 4 END AS layer FROM packets)"
        )
        source = "layered"
    for name, key, value in singles:
        v = "coalesce(t - lag(t) OVER (PARTITION BY key ORDER BY seq), 0)" if value == "gap" else value
        ctes += [
            f"{name}_base AS (SELECT *, {key} AS key FROM {source})",
            f"{name}_ev AS (SELECT seq AS pos, t, key, {v} AS v FROM {name}_base)",
            sums_sql(f"{name}_ev", f"{name}_sums", "key"),
            stats_cte(f"{name}_sums", f"{name}_st"),
        ]
    for name, src, dst in pairs:
        ctes += [
            f"{name}_ev AS (SELECT seq * 2 AS pos, t, {src} AS key, packet_size AS v FROM {source}"
            f" UNION ALL SELECT seq * 2 + 1, t, {dst}, -packet_size FROM {source})",
            sums_sql(f"{name}_ev", f"{name}_sums", "key"),
            stats_cte(f"{name}_sums", f"{name}_st"),
        ]
        fields = []
        for _, tag in TAGS:
            a = f"CASE WHEN p.loop THEN d.{{0}}_{tag} ELSE s.{{0}}_{tag} END"
            fields += [
                f"(p.packet_size - {a.format('m')}) * (p.packet_size - d.m_{tag}) AS r_{tag}",
                f"{a.format('w')} + d.w_{tag} AS total_{tag}",
                f"sqrt({a.format('q')}) * sqrt(d.q_{tag}) AS spread_{tag}",
                f"sqrt(pow({a.format('m')}, 2) + pow(d.m_{tag}, 2)) AS mag_{tag}",
                f"sqrt(pow({a.format('q')}, 2) + pow(d.q_{tag}, 2)) AS rad_{tag}",
            ]
        ctes.append(
            f"{name}_link AS (SELECT p.seq AS pos, p.t, p.link, row_number() OVER (PARTITION BY link ORDER BY p.seq) = 1"
            f" AS opens, {', '.join(fields)} FROM (SELECT *, {src} || '->' || {dst} AS link, {src} = {dst} AS loop"
            f" FROM {source}) p JOIN {name}_st s ON s.pos = p.seq * 2 JOIN {name}_st d ON d.pos = p.seq * 2 + 1)"
        )
        sums = ", ".join(
            f"sum(CASE WHEN b.opens THEN 0 ELSE b.r_{tag} END * pow(2, -{rate} * (a.t - b.t))) AS sr_{tag}"
            for rate, tag in TAGS
        )
        ctes.append(
            f"{name}_res AS (SELECT a.pos, {sums} FROM {name}_link a JOIN {name}_link b USING (link)"
            f" WHERE b.pos <= a.pos GROUP BY ALL)"
        )
        cov = ", ".join(
            f"CASE WHEN total_{tag} < 2e-3 THEN 0 ELSE sr_{tag} / total_{tag} END AS cov_{tag}" for _, tag in TAGS
        )
        ctes.append(f"{name}_cov AS (SELECT l.*, {cov} FROM {name}_link l JOIN {name}_res USING (pos))")
    return "WITH " + ",\n".join(ctes)


def pair_columns(name: str, out: str | None = None) -> list[str]:
    out = out or name
    columns = []
    for _, tag in TAGS:
        spread, cov = f"{name}_cov.spread_{tag}", f"{name}_cov.cov_{tag}"
        columns += [
            r(f"{name}_cov.mag_{tag}", f"{out}_{tag}_magnitude", 5),
            r(f"{name}_cov.rad_{tag}", f"{out}_{tag}_radius", 3),
            r(f"{name}_cov.cov_{tag}", f"{out}_{tag}_covariance", 4),
            r(f"CASE WHEN {spread} < 2e-3 THEN 0 ELSE {cov} / {spread} END", f"{out}_{tag}_pcc", 4),
        ]
    return columns


def joins(singles: list[str], pairs: list[str]) -> str:
    text = "FROM packets p"
    for name in singles:
        text += f" JOIN {name}_st ON {name}_st.pos = p.seq"
    for name in pairs:
        text += (
            f" JOIN {name}_st {name}_src ON {name}_src.pos = p.seq * 2"
            f" JOIN {name}_st {name}_dst ON {name}_dst.pos = p.seq * 2 + 1"
            f" JOIN {name}_cov ON {name}_cov.pos = p.seq"
        )
    return text


_IP_PAIR = [("channel", "src_ip", "dst_ip")]


@query(
    "two_role_statistics",
    f"{wide_sql([], _IP_PAIR)} SELECT p.seq, {', '.join(single_columns('channel_src', 'channel'))} {joins([], ['channel'])}",
)
def two_role_statistics(spark, sf):
    df = TR.link_statistics(packets(spark, sf), "src_ip", "dst_ip", "packet_size", name="channel", joint=False)
    return round_stats(df.select("seq", *[f"channel_{tag}_{s}" for _, tag in TAGS for s in TR.STATS_1D]))


@query(
    "link_covariance",
    f"{wide_sql([], _IP_PAIR)} SELECT p.seq, {', '.join(pair_columns('channel'))} {joins([], ['channel'])}",
)
def link_covariance(spark, sf):
    df = TR.link_statistics(packets(spark, sf), "src_ip", "dst_ip", "packet_size", name="channel")
    return round_stats(df.select("seq", *[f"channel_{tag}_{s}" for _, tag in TAGS for s in TR.STATS_2D]))


_T9_SINGLES = [("src_mac_ip", "src_mac || '_' || src_ip", "packet_size"), ("jitter", "src_ip || '_' || dst_ip", "gap")]
_T9_PAIRS = [
    ("channel", "src_ip", "dst_ip"),
    ("socket", "(src_ip || '_' || src_port)", "(dst_ip || '_' || dst_port)"),
]


@query(
    "traffic_features",
    wide_sql(_T9_SINGLES, _T9_PAIRS)
    + f" SELECT p.seq, {r('p.t', 't', 6)}, "
    + ", ".join(
        single_columns("src_mac_ip_st", "src_mac_ip")
        + single_columns("jitter_st", "jitter")
        + single_columns("channel_src", "channel")
        + pair_columns("channel")
        + single_columns("socket_src", "socket")
        + pair_columns("socket")
    )
    + " "
    + joins(["src_mac_ip", "jitter"], ["channel", "socket"]),
)
def traffic_features(spark, sf):
    return round_stats(TR.traffic_features(packets(spark, sf), stream=()).withColumn("t", F.round("t", 6)))


_LAYER_SRC = "(src_mac || '/' || layer)"
_LAYER_DST = "(dst_mac || '/' || layer)"


@query(
    "link_features",
    wide_sql(
        [("jitter", f"{_LAYER_SRC} || '-' || {_LAYER_DST}", "gap")], [("link", _LAYER_SRC, _LAYER_DST)], layered=True
    )
    + f" SELECT p.seq, {r('p.t', 't', 6)}, 1 AS type, p.src_mac AS src_id, p.dst_mac AS dst_id,"
    + " (SELECT layer FROM layered WHERE layered.seq = p.seq) AS protocol, "
    + ", ".join(
        single_columns("link_src", "src")
        + single_columns("link_dst", "dst")
        + single_columns("jitter_st", "jitter")
        + pair_columns("link")
    )
    + " "
    + joins(["jitter"], ["link"]),
)
def link_features(spark, sf):
    return round_stats(TR.link_features(packets(spark, sf), stream=()).withColumn("t", F.round("t", 6)))


@query(
    "frequency",
    f"""WITH {{packets}}, span AS (SELECT min(t) AS t0, max(t) AS t1 FROM packets),
      grid AS (SELECT t0, unnest(range(0, CAST(ceil(t1 - t0) AS BIGINT) - 1)) AS n FROM span),
      counts AS (SELECT CAST(floor(t - t0) AS BIGINT) AS n, count(*) AS frequency FROM packets, span GROUP BY 1)
      SELECT {r("t0 + n", "window_start", 6)}, coalesce(frequency, 0) AS frequency FROM grid LEFT JOIN counts USING (n)""",
)
def frequency_counts(spark, sf):
    return rounded(frequency(packets(spark, sf), 1.0), 6)


# The expiry needs faster decay than the packets' own rates to show within 30 days.
_FAST = (5.0, 3.0, 1.0)


@query(
    "idle_sessions",
    """WITH {packets}, base AS (SELECT *, src_ip || '_' || dst_ip AS key FROM packets),
      w AS (SELECT a.seq, a.t, a.key, sum(pow(2, -(a.t - b.t))) AS weight
            FROM base a JOIN base b USING (key) WHERE b.seq <= a.seq GROUP BY ALL),
      e AS (SELECT *, t + log2(weight / 1e-3) AS expires_at FROM w),
      f AS (SELECT *, CASE WHEN t > lag(expires_at) OVER (PARTITION BY key ORDER BY seq) THEN 1 ELSE 0 END AS fresh FROM e)
      SELECT seq, key, round(weight, 6) AS weight, round(expires_at, 6) AS expires_at,
        CAST(sum(fresh) OVER (PARTITION BY key ORDER BY seq) AS BIGINT) AS session FROM f""",
)
def idle_sessions(spark, sf):
    keyed = packets(spark, sf).selectExpr("seq", "t", f"{TR.KEYS['ip_pair']} AS key")
    return rounded(TR.idle_sessions(keyed, ["key"], rates=_FAST).drop("t"), 6)


@query(
    "statistics_with_expiry",
    f"""WITH {{packets}}, base AS (SELECT *, src_ip || '_' || dst_ip AS k FROM packets),
      w AS (SELECT a.seq, a.t, a.k, a.packet_size, sum(pow(2, -(a.t - b.t))) AS weight
            FROM base a JOIN base b USING (k) WHERE b.seq <= a.seq GROUP BY ALL),
      f AS (SELECT *, CASE WHEN t > lag(t + log2(weight / 1e-3)) OVER (PARTITION BY k ORDER BY seq) THEN 1 ELSE 0 END AS fresh FROM w),
      g AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY k ORDER BY seq) AS BIGINT) AS session FROM f),
      ev AS (SELECT seq AS pos, t, k || '|' || session AS key, packet_size AS v FROM g),
      {sums_sql("ev", "sums", "key")},
      {stats_cte("sums", "st")}
      SELECT g.seq, k AS stat_key, session, {", ".join(c for c in single_columns("st", "stat") if "_5_" in c or "_3_" in c or "_1_" in c)}
      FROM st JOIN g ON g.seq = st.pos""",
)
def statistics_with_expiry(spark, sf):
    df = TR.statistics_with_expiry(packets(spark, sf), TR.KEYS["ip_pair"], "packet_size", rates=_FAST)
    return round_stats(df.drop("t"))


@query(
    "expired_links",
    """WITH {packets}, base AS (SELECT *, CASE protocol WHEN 'TCP' THEN 0 WHEN 'UDP' THEN 1 WHEN 'ICMP' THEN 2
          WHEN 'ARP' THEN 3 ELSE 4 END AS layer FROM packets),
      w AS (SELECT file, a.seq, a.t, src_mac, dst_mac, layer, sum(pow(2, -3 * (a.t - b.t))) AS weight
            FROM base a JOIN base b USING (file, src_mac, dst_mac, layer) WHERE b.seq <= a.seq GROUP BY ALL),
      e AS (SELECT *, t + log2(weight / 1e-3) / 3 AS ends,
              lead(t) OVER (PARTITION BY file, src_mac, dst_mac, layer ORDER BY seq) AS next_t,
              lag(t + log2(weight / 1e-3) / 3) OVER (PARTITION BY file, src_mac, dst_mac, layer ORDER BY seq) AS before FROM w),
      s AS (SELECT *, CAST(sum(CASE WHEN t > before THEN 1 ELSE 0 END)
              OVER (PARTITION BY file, src_mac, dst_mac, layer ORDER BY seq) AS BIGINT) AS session FROM e),
      p AS (SELECT file AS pfile, t AS pt, seq AS pseq FROM packets)
      SELECT s.file, pseq AS seq, round(ends, 6) AS t, 0 AS type, src_mac AS src_id, dst_mac AS dst_id, layer AS protocol, session
      FROM s ASOF JOIN p ON s.file = p.pfile AND s.ends < p.pt WHERE next_t IS NULL OR next_t > ends""",
)
def expired_links(spark, sf):
    return rounded(TR.expired_links(packets(spark, sf), rates=(5.0, 3.0), stream=["file"]), 6)


@query(
    "peek_statistics",
    f"""WITH {{packets}}, hist AS (SELECT * FROM packets WHERE file = 'benign_0'),
      cand AS (SELECT * FROM packets WHERE file <> 'benign_0'),
      sums AS (SELECT c.seq AS pos, c.dst_ip AS key, c.packet_size AS v, {", ".join(
          f"1 + coalesce(sum(pow(2, -{rate} * (c.t - h.t))), 0) AS w_{tag},"
          f" any_value(c.packet_size) + coalesce(sum(h.packet_size * pow(2, -{rate} * (c.t - h.t))), 0) AS s_{tag},"
          f" any_value(c.packet_size * c.packet_size) + coalesce(sum(h.packet_size * h.packet_size * pow(2, -{rate} * (c.t - h.t))), 0) AS ss_{tag}"
          for rate, tag in TAGS)}
        FROM cand c LEFT JOIN hist h ON h.dst_ip = c.dst_ip AND h.t <= c.t GROUP BY 1, 2, 3),
      {stats_cte("sums", "st")}
      SELECT st.pos AS seq, key, {", ".join(single_columns("st", "stat"))} FROM st JOIN sums USING (pos)""",
)
def peek_statistics(spark, sf):
    view = packets(spark, sf)
    df = TR.peek(view.where("file = 'benign_0'"), view.where("file <> 'benign_0'"), "dst_ip", "packet_size")
    return round_stats(df.drop("t"))

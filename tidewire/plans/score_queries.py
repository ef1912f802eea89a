"""Queries of scaling, scoring, thresholds, drift and evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewire.functions import quantiles as Q
from tidewire.functions.columns import clip, finite_or, quantize, squeeze
from tidewire.operators import detect as D
from tidewire.operators import drift as R
from tidewire.operators import evaluate as E
from tidewire.operators import linear as A
from tidewire.operators import prequential as PQ
from tidewire.operators import scale as SC
from tidewire.operators import similarity as SI
from tidewire.operators import traffic as TR
from tidewire.operators.graph import layer_edges, layer_nodes
from tidewire.operators.windows import tumbling_snapshots
from tidewire.plans.registry import query, r, rounded
from tidewire.plans.traffic_queries import stats_cte, sums_sql
from tidewire.schema import packets, table
from tidewire.session import settle, staging_path

SIZES = ["packet_size", "k"]


def sized(spark, sf):
    """Packets with two numeric features."""
    return packets(spark, sf).selectExpr(
        "seq", "t", "batch_id", "protocol", "file", "packet_size", "cast(dst_port AS double) AS k"
    )


SIZED = "sized AS (SELECT seq, t, batch_id, protocol, file, packet_size, CAST(dst_port AS DOUBLE) AS k FROM packets)"


def prior_sql(source: str, features: list[str], target: str = "prior", own_first: bool = True) -> str:
    """CTE: quantiles and mean of all earlier batches per batch."""
    on = "s.batch_id < b.batch_id" + (" OR (b.batch_id = 0 AND s.batch_id = 0)" if own_first else "")
    cols = ", ".join(
        f"quantile_disc({f}, 0.16) AS {f}_q0, quantile_disc({f}, 0.5) AS {f}_q1, quantile_disc({f}, 0.84) AS {f}_q2,"
        f" avg({f}) AS {f}_mean"
        for f in features
    )
    return (
        f"{target} AS (SELECT b.batch_id, {cols} FROM (SELECT DISTINCT batch_id FROM {source}) b"
        f" JOIN {source} s ON {on} GROUP BY ALL)"
    )


def deviation_sql(features: list[str]) -> str:
    parts = [
        f"CASE WHEN {f}_mean IS NULL THEN 0 WHEN {f}_q2 - {f}_q0 <> 0 THEN abs({f} - {f}_mean) / ({f}_q2 - {f}_q0)"
        f" WHEN abs({f} - {f}_mean) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END"
        for f in features
    ]
    return f"greatest({', '.join(parts)}, 0)"


def scaled_sql(f: str) -> str:
    return (
        f"CASE WHEN {f}_q2 <> {f}_q0 THEN greatest(least(({f} - {f}_q1) / ({f}_q2 - {f}_q0), 1e6), -1e6) ELSE 0 END"
    )


@query(
    "running_scale",
    f"""WITH {{packets}}, {SIZED}, {prior_sql("sized", SIZES)}
      SELECT seq, batch_id, {r(scaled_sql("packet_size"), "packet_size")}, {r(scaled_sql("k"), "k")}
      FROM sized JOIN prior USING (batch_id)""",
)
def running_scale(spark, sf):
    return rounded(SC.running_scale(sized(spark, sf).select("seq", "batch_id", *SIZES), SIZES))


@query(
    "quantile_state",
    """WITH f AS (SELECT event_type, value FROM events)
      SELECT event_type, 'value' AS feature, count(*) AS rows, quantile_disc(value, 0.16) AS q0,
        quantile_disc(value, 0.5) AS q1, quantile_disc(value, 0.84) AS q2 FROM f GROUP BY ALL""",
)
def quantile_state(spark, sf):
    by_user = Q.quantile_state(table(spark, sf, "events"), ["value"], group=["event_type", "user_id"])
    path = staging_path(spark, "quantiles")
    by_user.write.parquet(path)  # one stored state per entity, merged on reading
    merged = Q.merge_states(spark.read.parquet(path), group=["event_type"])
    return Q.state_quantiles(merged, [0.16, 0.5, 0.84], group=["event_type"])


@query(
    "quantile_threshold",
    f"""SELECT l_returnflag, {r("quantile_cont(l_extendedprice, 0.99)", "threshold", 4)} FROM lineitem GROUP BY ALL""",
)
def quantile_threshold(spark, sf):
    return rounded(Q.quantile_threshold(table(spark, sf, "lineitem"), "l_extendedprice", 0.99, group=["l_returnflag"]), 4)


@query(
    "normal_threshold",
    f"""WITH {{packets}} SELECT file,
      {r("avg(packet_size) + 2.3263478740408408 * stddev_pop(packet_size)", "threshold", 4)} FROM packets GROUP BY ALL""",
)
def normal_threshold(spark, sf):
    return rounded(packets(spark, sf).groupBy("file").agg(Q.normal_quantile("packet_size", 0.99).alias("threshold")), 4)


@query(
    "log_normal_threshold",
    f"""WITH {{packets}} SELECT file,
      {r("exp(avg(ln(packet_size + 1e-6)) + 2.3263478740408408 * stddev_pop(ln(packet_size + 1e-6)))", "threshold", 3)}
      FROM packets GROUP BY ALL""",
)
def log_normal_threshold(spark, sf):
    return rounded(packets(spark, sf).groupBy("file").agg(Q.log_normal_quantile("packet_size", 0.99).alias("threshold")), 3)


def _reference_sql(low: float, centre: float, high: float) -> str:
    q = ", ".join(
        f"quantile_cont({f}, {p}) AS {f}_{name}"
        for f in ("l_quantity", "l_extendedprice")
        for name, p in (("a", low), ("c", centre), ("b", high))
    )
    cols = ", ".join(
        r(f"({f} - {f}_c) / (CASE WHEN {f}_b = {f}_a THEN 1 ELSE {f}_b - {f}_a END)", f)
        for f in ("l_quantity", "l_extendedprice")
    )
    return f"""WITH q AS (SELECT l_returnflag, {q} FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
      SELECT l_orderkey, l_linenumber, l_partkey, {cols} FROM lineitem JOIN q USING (l_returnflag)"""


def _reference(spark, sf, kind):
    lines = table(spark, sf, "lineitem")
    out = SC.reference_scale(
        lines, lines.where("l_linestatus = 'F'"), ["l_quantity", "l_extendedprice"], kind=kind, group=["l_returnflag"]
    )
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))


@query("min_max_scale", _reference_sql(0.01, 0.01, 0.99))
def min_max_scale(spark, sf):
    return _reference(spark, sf, "minmax")


@query("standard_scale", _reference_sql(0.16, 0.5, 0.84))
def standard_scale(spark, sf):
    return _reference(spark, sf, "standard")


_KS = ["l_quantity", "l_extendedprice", "l_discount"]


_KS_SQL = (
    "WITH v AS ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, l_linestatus, {f} AS v, l_returnflag = 'A' AS second FROM lineitem" for f in _KS
    )
    + """), c AS (SELECT l_linestatus, feature, v, count(*) FILTER (NOT second) AS a, count(*) FILTER (second) AS b FROM v GROUP BY ALL),
      u AS (SELECT *, sum(a) OVER w AS au, sum(b) OVER w AS bu, sum(a) OVER p AS n, sum(b) OVER p AS m FROM c
        WINDOW w AS (PARTITION BY l_linestatus, feature ORDER BY v), p AS (PARTITION BY l_linestatus, feature)),
      d AS (SELECT l_linestatus, feature, CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m,
        max(abs(au / n - bu / m)) AS statistic FROM u GROUP BY ALL)"""
)


@query("ks_statistic", f"{_KS_SQL} SELECT l_linestatus, feature, n, m, {r('statistic', 'statistic')} FROM d")
def ks_statistic(spark, sf):
    out = SC.ks_statistic(table(spark, sf, "lineitem"), _KS, "l_returnflag = 'A'", group=["l_linestatus"])
    return rounded(out.drop("p_value"))


@query(
    "ks_multivariate",
    f"""{_KS_SQL}, x AS (SELECT *, statistic * sqrt(n * m / (n + m)) AS x FROM d),
      j AS (SELECT unnest(range(1, 101)) AS j),
      p AS (SELECT l_linestatus, feature, statistic, CASE WHEN x < 0.2 THEN 1 ELSE
          greatest(0, least(1, sum(CASE WHEN j % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * j * j * x * x)))) END AS p_value
        FROM x, j GROUP BY l_linestatus, feature, statistic, x)
      SELECT l_linestatus, {r("min(p_value)", "p_value")}, {r("max(statistic)", "statistic")} FROM p GROUP BY ALL""",
)
def ks_multivariate(spark, sf):
    return rounded(SC.ks_multivariate(table(spark, sf, "lineitem"), _KS, "l_returnflag = 'A'", group=["l_linestatus"]))


@query(
    "reservoir_sample",
    """WITH {packets}, k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY md5('7:' || seq)) AS k FROM packets)
      SELECT file, seq, packet_size FROM k WHERE k <= 200""",
)
def reservoir_sample(spark, sf):
    return SC.reservoir(packets(spark, sf), ["file"], k=200, seed=7).select("file", "seq", "packet_size")


@query(
    "sampled_range",
    """WITH {packets} SELECT seq, round(t, 6) AS t, packet_size FROM packets WHERE seq >= 100 AND seq < 9000
      ORDER BY md5('3:' || seq) LIMIT 500""",
)
def sampled_range(spark, sf):
    return rounded(SC.sampled_range(packets(spark, sf), 100, 9000, 500, seed=3).select("seq", "t", "packet_size"))


def node_rows(spark, sf):
    rows = tumbling_snapshots(packets(spark, sf), 0.1)
    return layer_nodes(rows, "physical"), layer_edges(rows, "physical")


@query("concept_drift")
def concept_drift(spark, sf):
    return R.concept_drift(node_rows(spark, sf)[0], ["count", "size"])


@query("concept_graph")
def concept_graph(spark, sf):
    nodes, edges = node_rows(spark, sf)
    return R.scored_graph(R.concept_drift(nodes, ["count", "size"]), edges)[1]


@query("concept_info")
def concept_info(spark, sf):
    return R.concept_info(R.concept_drift(node_rows(spark, sf)[0], ["count", "size"]))


@query(
    "drift_levels",
    f"""WITH {{packets}}, sc AS (SELECT file, seq // 32 AS batch_id, seq, packet_size AS score FROM packets),
      m AS (SELECT file, batch_id, quantile_cont(score, 0.5) AS median FROM sc GROUP BY ALL),
      en AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY batch_id, kind, seq) - 1 AS e FROM (
        SELECT file, batch_id, 0 AS kind, 0 AS seq, median AS v FROM m WHERE median <= 35
        UNION ALL SELECT file, batch_id, 1, seq, score FROM sc)),
      o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY batch_id) AS place FROM m),
      h AS (SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY file ORDER BY place) - 1 <= 4 THEN 0 ELSE 1 END AS start FROM o WHERE median > 35),
      s AS (SELECT *, sum(start) OVER (PARTITION BY file ORDER BY place) AS stretch FROM h),
      t AS (SELECT *, (row_number() OVER (PARTITION BY file, stretch ORDER BY place) - 1) // 20 AS turn FROM s),
      q AS (SELECT file, max(batch_id) AS batch_id, quantile_cont(median, [0.01, 0.5, 0.99]) AS above
        FROM t GROUP BY file, stretch, turn HAVING count(*) = 20),
      st AS (SELECT q.file, q.batch_id, any_value(above) AS above, min(e) AS fin FROM q JOIN en ON en.file = q.file AND en.batch_id = q.batch_id GROUP BY q.file, q.batch_id),
      b AS (SELECT st.file, st.batch_id, any_value(above) AS above, quantile_cont(v, [0.01, 0.5, 0.99]) AS below
        FROM st JOIN en ON en.file = st.file AND e < fin AND e >= fin - 20 GROUP BY st.file, st.batch_id),
      ev AS (SELECT file, batch_id, 20 * pow(above[2] - below[2], 2) / pow(greatest(above[3], below[3]) - least(above[1], below[1]), 2) AS level FROM b)
      SELECT o.file, o.batch_id, {r("coalesce(level, 0)", "drift_level")},
        CASE WHEN level > 0.5 THEN 'malicious' WHEN level IS NOT NULL THEN 'benign' ELSE 'none' END AS drift,
        CAST(least(20, 1 + sum(CASE WHEN level <= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY o.file ORDER BY o.batch_id)) AS INTEGER) AS num_model
      FROM o LEFT JOIN ev ON ev.file = o.file AND ev.batch_id = o.batch_id""",
)
def drift_levels(spark, sf):
    rows = packets(spark, sf).selectExpr("file", "floor(seq / 32) AS batch_id", "seq", "packet_size AS score", "35D AS threshold")
    return rounded(R.drift_levels(rows, stream=["file"], patience=20, confidence=0.5))


# A pool of three models: the scores differ in what they measure.
_POOL = """pool AS (SELECT batch_id, seq, 'size' AS model, packet_size AS score FROM packets UNION ALL
      SELECT batch_id, seq, 'log', ln(packet_size + 1) FROM packets UNION ALL
      SELECT batch_id, seq, 'port', CAST(dst_port AS DOUBLE) FROM packets),
    base AS (SELECT model, avg(score) AS last_mean, min(score) AS last_min, max(score) AS last_max
      FROM pool WHERE batch_id = 0 GROUP BY ALL),
    now AS (SELECT batch_id, model, avg(score) AS mean, min(score) AS lo, max(score) AS hi, count(*) AS n,
      stddev_pop(score) AS std FROM pool GROUP BY ALL),
    rel AS (SELECT *, exp(-2 * pow(mean - last_mean, 2) / ((2.0 / n) * pow(greatest(hi, last_max) - least(lo, last_min), 2)))
      AS reliability FROM now JOIN base USING (model))"""


def _pool(spark, sf):
    rows = packets(spark, sf).selectExpr(
        "batch_id",
        "seq",
        "inline(array(named_struct('model', 'size', 'score', packet_size), named_struct('model', 'log', 'score',"
        " ln(packet_size + 1)), named_struct('model', 'port', 'score', cast(dst_port AS double))))",
    )
    base = rows.where("batch_id = 0").groupBy("model").agg(
        F.avg("score").alias("last_mean"), F.min("score").alias("last_min"), F.max("score").alias("last_max")
    )
    return rows, base


@query(
    "pool_reliability",
    f"""WITH {{packets}}, {_POOL} SELECT batch_id, model, {r("reliability", "reliability")}, {r("mean", "mean")},
      {r("std", "std")}, n FROM rel""",
)
def pool_reliability(spark, sf):
    return rounded(R.pool_reliability(*_pool(spark, sf)))


@query(
    "pool_scores",
    f"""WITH {{packets}}, {_POOL}
      SELECT batch_id, seq, {r("sum(reliability * (score - mean) / std)", "score", 5)},
        {r("1 - product(1 - reliability)", "drift_level", 6)}
      FROM pool JOIN rel USING (batch_id, model) GROUP BY ALL""",
)
def pool_scores(spark, sf):
    return rounded(R.pool_scores(*_pool(spark, sf)), 5, drift_level=6)


_CKA_X, _CKA_Y = ["l_quantity", "l_extendedprice"], ["l_discount", "l_tax", "l_quantity"]


def _hsic_sql(a: list[str], b: list[str]) -> str:
    return " + ".join(f"pow(covar_pop({p}, {q}) * count(*), 2)" for p in a for q in b)


@query(
    "linear_cka",
    f"""SELECT l_returnflag, {r(f"({_hsic_sql(_CKA_X, _CKA_Y)}) / sqrt(({_hsic_sql(_CKA_X, _CKA_X)}) * ({_hsic_sql(_CKA_Y, _CKA_Y)}))", "cka")}
      FROM lineitem GROUP BY ALL""",
)
def linear_cka(spark, sf):
    out = A.linear_cka(table(spark, sf, "lineitem"), _CKA_X, _CKA_Y, group=["l_returnflag"])
    return rounded(out.select("l_returnflag", "cka"))


@query(
    "kernel_cka",
    f"""WITH {{packets}}, p AS (SELECT batch_id, seq, packet_size AS a, CAST(dst_port AS DOUBLE) AS b, t AS c FROM packets),
      d AS (SELECT x.batch_id, x.seq AS i, y.seq AS j, pow(x.a - y.a, 2) AS dx, pow(x.b - y.b, 2) + pow(x.c - y.c, 2) AS dy
        FROM p x JOIN p y USING (batch_id)),
      s AS (SELECT batch_id, quantile_cont(dx, 0.5) FILTER (dx <> 0) AS sx, quantile_cont(dy, 0.5) FILTER (dy <> 0) AS sy FROM d GROUP BY ALL),
      k AS (SELECT batch_id, i, j, exp(-0.5 * dx / sx) AS kx, exp(-0.5 * dy / sy) AS ky FROM d JOIN s USING (batch_id)),
      m AS (SELECT batch_id, i, avg(kx) AS mx, avg(ky) AS my FROM k GROUP BY ALL),
      g AS (SELECT batch_id, avg(mx) AS gx, avg(my) AS gy FROM m GROUP BY ALL),
      c AS (SELECT k.batch_id, kx - a.mx - b.mx + gx AS cx, ky - a.my - b.my + gy AS cy FROM k JOIN g USING (batch_id)
        JOIN m a ON a.batch_id = k.batch_id AND a.i = k.i JOIN m b ON b.batch_id = k.batch_id AND b.i = k.j)
      SELECT batch_id, {r("sum(cx * cy) / sqrt(sum(cx * cx) * sum(cy * cy))", "cka")} FROM c GROUP BY ALL""",
)
def kernel_cka(spark, sf):
    view = packets(spark, sf).selectExpr("batch_id", "packet_size AS a", "cast(dst_port AS double) AS b", "t AS c")
    return rounded(SI.kernel_cka(view, ["a"], ["b", "c"]))


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", *_LINE)


@query("merged_models")
def merged_models(spark, sf):
    lines = _lines(spark, sf)
    pool = D.fit_pool(lines, _LINE, group="l_returnflag")
    merged, found = D.merge_most_similar(lines, _LINE, pool, k=2)
    sizes = {str(name): m.n for name, m in merged.items()}
    return found.withColumn("models_left", F.lit(len(sizes))).withColumn("rows_merged", F.lit(max(sizes.values())))


@query(
    "residual_distances",
    f"""WITH m AS (SELECT avg(l_discount) AS ma, avg(l_tax) AS mb, var_pop(l_discount) AS a, var_pop(l_tax) AS c,
        covar_pop(l_discount, l_tax) AS b, count(*) AS n FROM lineitem)
      SELECT l_orderkey, l_linenumber, l_partkey, {r("l_discount * l_discount + l_tax * l_tax", "sap")},
        {r("sqrt((c * pow(l_discount - ma, 2) - 2 * b * (l_discount - ma) * (l_tax - mb) + a * pow(l_tax - mb, 2)) / ((a * c - b * b) * n))", "nap")}
      FROM lineitem, m""",
)
def residual_distances(spark, sf):
    out = A.residual_distances(_lines(spark, sf), ["l_discount", "l_tax"])
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "sap", "nap"))


@query("sliced_wasserstein")
def sliced_wasserstein(spark, sf):
    return SI.sliced_wasserstein(sized(spark, sf), SIZES, slices=20)


@query(
    "deviation_scores",
    f"""WITH {{packets}}, {SIZED}, {prior_sql("sized", SIZES, own_first=False)}
      SELECT seq, batch_id, {r(deviation_sql(SIZES), "score")} FROM sized LEFT JOIN prior USING (batch_id)""",
)
def deviation_scores(spark, sf):
    out = D.deviation_scores(sized(spark, sf), SIZES)
    return rounded(out.select("seq", "batch_id", "score"))


@query(
    "rolling_threshold",
    f"""WITH {{packets}}, b AS (SELECT DISTINCT batch_id FROM packets),
      q AS (SELECT b.batch_id, quantile_cont(packet_size, 0.99) AS q FROM b JOIN packets p
        ON p.seq < b.batch_id * 1024 AND p.seq >= b.batch_id * 1024 - 3000 GROUP BY ALL)
      SELECT batch_id, {r("CASE WHEN batch_id >= 2 THEN q ELSE -1 END", "threshold")} FROM b LEFT JOIN q USING (batch_id)""",
)
def rolling_threshold(spark, sf):
    scores = packets(spark, sf).selectExpr("seq", "batch_id", "packet_size AS score")
    return rounded(D.rolling_threshold(scores, queue=3000, warmup=2))


@query("adaptive_threshold")
def adaptive_threshold(spark, sf):
    scores = packets(spark, sf).selectExpr("seq", "floor(seq / 64) AS batch_id", "packet_size AS score")
    return D.adaptive_threshold(scores, queue=1000, warmup=30, chunk_batches=50)


@query(
    "reconstruction_scores",
    f"""WITH m AS (SELECT avg(l_discount) AS ma, avg(l_tax) AS mb, var_pop(l_discount) AS a, var_pop(l_tax) AS c,
        covar_pop(l_discount, l_tax) AS b FROM lineitem),
      e AS (SELECT *, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS low FROM m),
      v AS (SELECT *, b / sqrt(b * b + pow(low - a, 2)) AS vx, (low - a) / sqrt(b * b + pow(low - a, 2)) AS vy FROM e)
      SELECT l_orderkey, l_linenumber, l_partkey,
        {r("pow((l_discount - ma) * vx + (l_tax - mb) * vy, 2) / 2", "score")} FROM lineitem, v""",
)
def reconstruction_scores(spark, sf):
    out = D.reconstruction_scores(_lines(spark, sf), ["l_discount", "l_tax"], 1)
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "score"))


# Models of the earlier batches only. ``before`` holds, per batch, the moments of the rows that came before it.


def before_sql(source: str, a: str, b: str) -> str:
    return f"""g AS (SELECT batch_id, count(*) AS n, sum({a}) AS sa, sum({b}) AS sb, sum({a} * {a}) AS saa, sum({b} * {b}) AS sbb,
        sum({a} * {b}) AS sab FROM {source} GROUP BY ALL),
      u AS (SELECT batch_id, sum(n) OVER w AS n, sum(sa) OVER w AS sa, sum(sb) OVER w AS sb, sum(saa) OVER w AS saa,
        sum(sbb) OVER w AS sbb, sum(sab) OVER w AS sab FROM g
        WINDOW w AS (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      m AS (SELECT batch_id, sa / n AS ma, sb / n AS mb, saa / n - (sa / n) * (sa / n) AS va, sbb / n - (sb / n) * (sb / n) AS vb,
        sab / n - (sa / n) * (sb / n) AS c FROM u),
      e AS (SELECT *, (va + vb) / 2 - sqrt(pow((va - vb) / 2, 2) + c * c) AS low FROM m),
      v AS (SELECT *, c / sqrt(c * c + pow(low - va, 2)) AS vx, (low - va) / sqrt(c * c + pow(low - va, 2)) AS vy FROM e)"""


@query(
    "reconstruction_stream",
    f"""WITH {{packets}}, {SIZED}, x AS (SELECT seq, batch_id, packet_size / 100 AS a, k / 100 AS b FROM sized),
      {before_sql("x", "a", "b")}
      SELECT seq, batch_id, {r("pow((a - ma) * vx + (b - mb) * vy, 2) / 2", "score")} FROM x LEFT JOIN v USING (batch_id)""",
)
def reconstruction_stream(spark, sf):
    rows = sized(spark, sf).selectExpr("seq", "batch_id", "packet_size / 100 AS a", "k / 100 AS b")
    return rounded(PQ.reconstruction_stream(rows, ["a", "b"], 1, block_batches=3).select("seq", "batch_id", "score"))


def _images_sql(dim: int = 1) -> str:
    """Two maps to one dimension each: the own distance plus the log of all distances' exponentials."""
    w = PQ.Transformations(2, 2, dim).weights[:, :, 0]
    image = [f"({float(w[t][0])!r} * a + {float(w[t][1])!r} * b)" for t in range(2)]
    mean = [f"({float(w[t][0])!r} * ma + {float(w[t][1])!r} * mb)" for t in range(2)]
    d = [[f"pow({image[i]} - {mean[j]}, 2)" for j in range(2)] for i in range(2)]
    return " + ".join(f"{d[i][i]} + ln(exp(-{d[i][0]}) + exp(-{d[i][1]}))" for i in range(2))


@query(
    "transformation_stream",
    f"""WITH {{packets}}, {SIZED}, x AS (SELECT seq, batch_id, packet_size / 100 AS a, k / 100 AS b FROM sized),
      g AS (SELECT batch_id, avg(a) AS ma, avg(b) AS mb FROM x GROUP BY ALL),
      v AS (SELECT batch_id, avg(ma) OVER w AS ma, avg(mb) OVER w AS mb FROM g
        WINDOW w AS (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT seq, batch_id, {r(_images_sql(), "score")} FROM x LEFT JOIN v USING (batch_id)""",
)
def transformation_stream(spark, sf):
    rows = sized(spark, sf).selectExpr("seq", "batch_id", "packet_size / 100 AS a", "k / 100 AS b")
    return rounded(PQ.transformation_stream(rows, ["a", "b"], transforms=2, dim=1, block_batches=3).select("seq", "batch_id", "score"))


def _numbered(spark, sf):
    df, names = _wide(spark, sf)
    return df.withColumn("batch_id", F.floor(F.col("vec_id") / 64)), names


@query("ensemble_stream")
def ensemble_stream(spark, sf):
    df, names = _numbered(spark, sf)
    return PQ.ensemble_stream(df, names, warmup=2, max_size=8).select("vec_id", "batch_id", "score")


@query("one_class_stream")
def one_class_stream(spark, sf):
    df, names = _numbered(spark, sf)
    return PQ.one_class_stream(df, names, group_batches=4).select("vec_id", "batch_id", "score")


@query("feedback_detection")
def feedback_detection(spark, sf):
    rows = sized(spark, sf).selectExpr("seq", "floor(seq / 64) AS batch_id", "packet_size / 100 AS a", "k / 100 AS b")
    return PQ.feedback_scores(rows, ["a", "b"], PQ.Reconstruction(2, 1), queue=1000, warmup=30, chunk_batches=50)


def _wide(spark, sf):
    names = [f"x{i}" for i in range(64)]
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id", "label", *[f"cast(embedding[{i}] AS double) AS {n}" for i, n in enumerate(names)]
    ), names


@query("feature_clusters")
def feature_clusters(spark, sf):
    df, names = _wide(spark, sf)
    groups = D.correlation_clusters(A.moments(df, names)[()], 8)
    rows = [(names[i], number) for number, group in enumerate(groups) for i in group]
    return spark.createDataFrame(rows, "feature string, cluster int")


@query("ensemble_scores")
def ensemble_scores(spark, sf):
    df, names = _wide(spark, sf)
    return D.ensemble_scores(df, names, max_size=8).select("vec_id", "score")


@query("one_class_scores")
def one_class_scores(spark, sf):
    df, names = _wide(spark, sf)
    w, rho = D.one_class_svm(df, names, iterations=10)
    return D.one_class_scores(df, names, w, rho).select("vec_id", "score")


@query("transformation_scores")
def transformation_scores(spark, sf):
    df, names = _wide(spark, sf)
    return D.transformation_scores(df, names).select("vec_id", "score")


def _norm_model():
    return lambda x: np.sqrt((x * x).sum(axis=1))


@query(
    "user_model_scores",
    f"""SELECT l_orderkey, l_linenumber, l_partkey,
      {r("sqrt(" + " + ".join(f"{f} * {f}" for f in _LINE) + ")", "score", 4)} FROM lineitem""",
)
def user_model_scores(spark, sf):
    out = D.score_with(_lines(spark, sf), _LINE, _norm_model)
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "score"), 4)


# Evaluation. Scores: packet sizes against 100, missing for one protocol.

_SCORES = """scores AS (SELECT file, batch_id, seq, t, CASE WHEN protocol = 'Other' THEN NULL ELSE packet_size END AS score,
      CAST(100 AS DOUBLE) AS threshold FROM packets)"""


def scores(spark, sf):
    return packets(spark, sf).selectExpr(
        "file", "batch_id", "seq", "t", "CASE WHEN protocol = 'Other' THEN NULL ELSE packet_size END AS score", "100D AS threshold"
    )


_METRIC_COLS = """count(*) FILTER (score > threshold) / count(*) AS detection_rate,
      quantile_cont(score, 0.25) AS lower_quartile_score, quantile_cont(score, 0.75) AS upper_quartile_score,
      quantile_cont(score, 0.01) AS soft_min_score, quantile_cont(score, 0.99) AS soft_max_score,
      quantile_cont(score, 0.5) AS median_score, median(threshold) AS median_threshold,
      count(*) FILTER (score > threshold) AS pos_count, count(*) AS batch_size"""
_METRICS = f"metrics AS (SELECT file, batch_id, max(t) AS t, {_METRIC_COLS} FROM scores GROUP BY file, batch_id)"
_DOUBLES = [
    "detection_rate", "lower_quartile_score", "upper_quartile_score", "soft_min_score", "soft_max_score",
    "median_score", "median_threshold",
]


def file_metrics(spark, sf):
    return E.batch_metrics(scores(spark, sf), by=["file", "batch_id"], time="t")


@query(
    "file_batch_metrics",
    f"""WITH {{packets}}, {_SCORES}, {_METRICS} SELECT file, batch_id, {r("t", "t")},
      {", ".join(r(c, c) for c in _DOUBLES)}, pos_count, batch_size FROM metrics""",
)
def file_batch_metrics(spark, sf):
    return rounded(file_metrics(spark, sf))


# The flagship: decayed statistics, their deviation from all earlier batches, a rolling threshold, batch metrics.
_FLAG = ["stat_1_weight", "stat_1_mean", "stat_0p1_weight", "stat_0p1_mean"]


@query(
    "batch_metrics",
    f"""WITH {{packets}}, ev AS (SELECT seq AS pos, t, src_mac || '_' || src_ip AS key, packet_size AS v FROM packets),
      {sums_sql("ev", "sums", "key")}, {stats_cte("sums", "st")},
      feat AS (SELECT pos AS seq, pos // 1024 AS batch_id, {", ".join(
          f"{'w' if f.endswith('weight') else 'm'}_{f.split('_')[1]} AS {f}" for f in _FLAG)} FROM st),
      {prior_sql("feat", _FLAG, own_first=False)},
      sc AS (SELECT seq, batch_id, {deviation_sql(_FLAG)} AS score FROM feat LEFT JOIN prior USING (batch_id)),
      b AS (SELECT DISTINCT batch_id FROM sc),
      q AS (SELECT b.batch_id, quantile_cont(score, 0.99) AS q FROM b JOIN sc p
        ON p.seq < b.batch_id * 1024 AND p.seq >= b.batch_id * 1024 - 10000 GROUP BY ALL),
      scores AS (SELECT sc.*, CASE WHEN batch_id >= 3 THEN q ELSE -1 END AS threshold FROM sc LEFT JOIN q USING (batch_id)),
      metrics AS (SELECT batch_id, {_METRIC_COLS} FROM scores GROUP BY batch_id)
      SELECT batch_id, {", ".join(r(c, c, 4) for c in _DOUBLES)}, pos_count, batch_size FROM metrics""",
)
def batch_metrics(spark, sf):
    features = TR.keyed_statistics(
        packets(spark, sf), TR.KEYS["mac_ip"], "packet_size", rates=(1.0, 0.1), keep=("batch_id",)
    ).select("seq", "batch_id", *_FLAG)
    scored = settle(D.deviation_scores(features, _FLAG).select("seq", "batch_id", "score"))
    thresholds = D.rolling_threshold(scored, warmup=3)
    return rounded(E.batch_metrics(scored.join(thresholds, on="batch_id")), 4)


@query(
    "positives",
    f"WITH {{packets}}, {_SCORES} SELECT file, batch_id, seq, score FROM scores WHERE score > threshold",
)
def positives(spark, sf):
    return E.positives(scores(spark, sf)).select("file", "batch_id", "seq", "score")


@query(
    "drift_fields",
    f"""WITH {{packets}}, {_POOL}, p AS (SELECT batch_id, 1 - product(1 - reliability) AS drift_level, count(*) AS pool_size FROM rel GROUP BY ALL)
      SELECT batch_id, {r("drift_level", "drift_level")}, pool_size FROM p""",
)
def drift_fields(spark, sf):
    reliable = R.pool_reliability(*_pool(spark, sf))
    return rounded(
        reliable.groupBy("batch_id").agg(
            (1 - F.product(1 - F.col("reliability"))).alias("drift_level"), F.count("*").alias("pool_size")
        )
    )


@query(
    "column_summary",
    f"""WITH {{packets}}, {_SCORES}, {_METRICS} SELECT {", ".join(r(f"avg({c})", c) for c in ("detection_rate", "median_score", "median_threshold"))},
      CAST(sum(pos_count) AS BIGINT) AS pos_count, CAST(sum(batch_size) AS BIGINT) AS batch_size FROM metrics""",
)
def column_summary(spark, sf):
    return rounded(E.column_summary(file_metrics(spark, sf)))


def _ap_sql(positive: str, source: str = "metrics", by: str = "") -> str:
    key = f"{by}, " if by else ""
    match = f"b.{by} = f.{by}" if by else "true"
    return f"""lab AS (SELECT {key}file, median_score AS score, (file LIKE '{positive}%')::INT AS y, file LIKE 'benign%' AS benign FROM {source}),
      files AS (SELECT DISTINCT {key}file FROM lab WHERE NOT benign),
      ranked AS (SELECT {key}file AS pair, score, y FROM lab WHERE NOT benign UNION ALL SELECT {key}'*', score, y FROM lab
        UNION ALL SELECT {"b." + by + ", " if by else ""}f.file, b.score, b.y FROM lab b JOIN files f ON {match} WHERE b.benign),
      ties AS (SELECT {key}pair, score, sum(y) AS p, count(*) AS n FROM ranked GROUP BY ALL),
      steps AS (SELECT *, sum(p) OVER w AS pu, sum(n) OVER w AS nu FROM ties WINDOW w AS (PARTITION BY {key}pair ORDER BY score DESC)),
      aps AS (SELECT {key}pair, sum(p * pu / nu) / sum(p) AS ap FROM steps GROUP BY ALL),
      wts AS (SELECT {key}file AS pair, count(*) AS w FROM lab WHERE NOT benign GROUP BY ALL),
      summary AS (SELECT {key}max(ap) FILTER (pair = '*') AS pooled_ap, avg(ap) FILTER (pair <> '*') AS macro_ap,
        sum(ap * w) / sum(w) AS weighted_ap FROM aps LEFT JOIN wts USING ({key}pair) {"GROUP BY " + by if by else ""})"""


_APS = ("pooled_ap", "macro_ap", "weighted_ap")


@query(
    "detection_summary",
    f"""WITH {{packets}}, {_SCORES}, {_METRICS}, {_ap_sql("benign")} SELECT {", ".join(r(c, c) for c in _APS)} FROM summary""",
)
def detection_summary(spark, sf):
    return rounded(E.detection_summary(file_metrics(spark, sf)))


@query(
    "file_accuracy",
    f"""WITH {{packets}}, {_SCORES}, {_METRICS} SELECT file,
      {r("CASE WHEN file LIKE 'benign%' THEN 1 - sum(pos_count) / sum(batch_size) ELSE sum(pos_count) / sum(batch_size) END", "accuracy")}
      FROM metrics GROUP BY file""",
)
def file_accuracy(spark, sf):
    return rounded(E.file_accuracy(file_metrics(spark, sf)))


@query(
    "run_statistics",
    f"""WITH {{packets}}, {_SCORES}, {_METRICS}, a AS (SELECT
        sum(pos_count) FILTER (file LIKE 'benign%') AS pb, sum(batch_size) FILTER (file LIKE 'benign%') AS tb,
        sum(pos_count) FILTER (file LIKE 'attack%') AS pm, sum(batch_size) FILTER (file LIKE 'attack%') AS tm,
        avg(1 - pos_count / batch_size) FILTER (file LIKE 'benign%') AS ab,
        avg(pos_count / batch_size) FILTER (file LIKE 'attack%') AS am FROM metrics)
      SELECT CAST(pb AS BIGINT) AS pos_benign, CAST(tb AS BIGINT) AS total_benign, CAST(pm AS BIGINT) AS pos_malicious,
        CAST(tm AS BIGINT) AS total_malicious, {r("ab", "acc_benign")}, {r("am", "acc_malicious")},
        {r("2.0 * pm / (2 * pm + (tm - pm) + pb)", "f1")}, {r("2 * ab * am / (ab + am)", "hmean_acc")} FROM a""",
)
def run_statistics(spark, sf):
    return rounded(E.run_statistics(file_metrics(spark, sf)))


_SETS = E.parameter_sets({"power": [0.5, 1.0, 2.0], "cap": [50.0, 400.0], "form": "power"})


@query(
    "best_parameters",
    f"""WITH {{packets}}, {_SCORES}, sets(param_id, power, cap) AS (VALUES {", ".join(f"({i}, {s['power']}, {s['cap']})" for i, s in enumerate(_SETS))}),
      tuned AS (SELECT param_id, power, cap, file, batch_id, CAST(100 AS DOUBLE) AS threshold,
        pow(abs(score - cap), power) AS score FROM scores, sets),
      metrics AS (SELECT param_id, power, cap, file, batch_id, {_METRIC_COLS} FROM tuned GROUP BY param_id, power, cap, file, batch_id),
      {_ap_sql("benign", by="param_id")}
      SELECT param_id, {", ".join(r(c, c) for c in _APS)}, {r("pooled_ap + macro_ap + weighted_ap", "objective")}
      FROM summary ORDER BY round(pooled_ap + macro_ap + weighted_ap, 12) DESC, param_id LIMIT 1""",
)
def best_parameters(spark, sf):
    tuned = E.with_parameters(scores(spark, sf), _SETS).withColumn(
        "score", F.pow(F.abs(F.col("score") - F.col("cap")), F.col("power"))
    )
    metrics = E.batch_metrics(tuned, by=["param_id", "file", "batch_id"])
    return rounded(E.best_parameters(E.detection_summary(metrics, by=["param_id"])))


@query(
    "score_bands",
    f"""WITH {{packets}}, {_SCORES}, m AS (SELECT batch_id, max(t) AS t, {_METRIC_COLS} FROM scores GROUP BY batch_id)
      SELECT date_trunc('second', make_timestamp(CAST(round(t * 86400, 3) * 1000000 AS BIGINT))) AS time, {", ".join(r(c, c) for c in (
          "soft_min_score", "lower_quartile_score", "median_score", "upper_quartile_score", "soft_max_score", "median_threshold"))} FROM m""",
)
def score_bands(spark, sf):
    metrics = E.batch_metrics(scores(spark, sf), time="t")
    out = E.score_bands(metrics, seconds_per_unit=86_400.0)
    return rounded(out.withColumn("time", F.date_trunc("second", "time").cast("timestamp_ntz")))


@query(
    "table_difference",
    """WITH {packets}, a AS (SELECT src_ip, CAST(count(*) AS BIGINT) AS n, round(sum(packet_size), 6) AS bytes FROM packets GROUP BY ALL),
      b AS (SELECT src_ip, CAST(count(*) AS BIGINT) AS n, round(sum(packet_size), 6) AS bytes FROM packets WHERE protocol <> 'ARP' GROUP BY ALL)
      (SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b))
      UNION ALL (SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))""",
)
def table_difference(spark, sf):
    def totals(df):
        return df.groupBy("src_ip").agg(F.count("*").alias("n"), F.sum("packet_size").alias("bytes"))

    view = packets(spark, sf)
    return E.table_difference(totals(view), totals(view.where("protocol <> 'ARP'")), digits=6)


@query(
    "clipped_values",
    f"""SELECT l_orderkey, l_linenumber, l_partkey,
      {r("CASE WHEN l_tax = 0 THEN 0 ELSE greatest(least(l_extendedprice / l_tax, 1e6), -1e6) END", "ratio", 4)}
      FROM lineitem""",
)
def clipped_values(spark, sf):
    ratio = F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.col("l_extendedprice") / F.col("l_tax"))
    lines = _lines(spark, sf).withColumn("ratio", clip(finite_or(ratio, 0.0), 1e6))
    return rounded(lines.select("l_orderkey", "l_linenumber", "l_partkey", "ratio"), 4)


@query(
    "squeezed_values",
    """SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 8, 1) AS squeezed,
      round(round_even(l_discount * 15, 0) / 15, 9) AS quantized FROM lineitem""",
)
def squeezed_values(spark, sf):
    lines = _lines(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        squeeze(F.col("l_quantity") / 8, 1).alias("squeezed"),
        F.round(quantize("l_discount", 4), 9).alias("quantized"),
    )
    return lines


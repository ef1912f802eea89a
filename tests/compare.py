"""Run a registered query in Spark and its SQL counterpart in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

# The command line compares every rounded digit; the tests allow the last one to differ.
STRICT = False


def _equal(a, b) -> bool:
    return a == b


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value + 0.0:.12g}")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def _near(a, b) -> bool:
    """Equal up to the last rounded digit; a correlation over a vanishing spread carries few digits."""
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= max(1e-4 * max(abs(a), abs(b)), 2e-6)
    return a == b


def _sorted(rows):
    """Rows ordered by their exact values first, so that a last digit cannot move one."""
    return sorted(rows, key=lambda row: ([repr(v) for v in row if not isinstance(v, float)], [v for v in row if isinstance(v, float)]))


def difference(spark, folder: str, function, sql: str) -> str | None:
    """None if both results hold the same columns and rows, else a short report."""
    df = function(spark, folder)
    names = sorted(df.columns)
    mine = _sorted(tuple(_plain(row[c]) for c in names) for row in df.select(*names).collect())
    con = connect(folder)
    result = con.sql(sql)
    if sorted(result.columns) != names:
        return f"columns differ: {set(result.columns) ^ set(names)}"
    place = {c: i for i, c in enumerate(result.columns)}
    theirs = _sorted(tuple(_plain(row[place[c]]) for c in names) for row in result.fetchall())
    if len(mine) != len(theirs):
        return f"rows: spark {len(mine)}, sql {len(theirs)}"
    same = _equal if STRICT else _near
    wrong = [(a, b) for a, b in zip(mine, theirs, strict=True) if not all(map(same, a, b))]
    if wrong:
        a, b = wrong[0]
        cells = [(names[i], a[i], b[i]) for i in range(len(names)) if not same(a[i], b[i])]
        return f"{len(wrong)} of {len(mine)} rows differ, e.g. {cells[:4]}"
    return None


def main(argv: list[str]) -> int:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from tidewire.plans.catalog import ORACLES, QUERIES
    from tidewire.session import local_session

    folder = argv[0]
    wanted = argv[1:] or list(QUERIES)
    spark = local_session(cores="8", **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    global STRICT
    STRICT = True
    for name in wanted:
        start = time.time()
        try:
            if name in ORACLES:
                report = difference(spark, folder, QUERIES[name], ORACLES[name])
            else:
                report = None if QUERIES[name](spark, folder).count() > 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            report = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += report is not None
        print(f"{'ok  ' if report is None else 'FAIL'} {name} {time.time() - start:.1f}s {'' if name in ORACLES else '(rows)'} {report or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

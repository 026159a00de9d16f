"""Run registered queries against their SQL and report differences.

``python -m checks.compare [sf dir] [query ...]``
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time

from checks.oracles import ORACLES
from checks.queries import QUERIES


def _plain(value):
    if isinstance(value, decimal.Decimal | float):
        return round(float(value), 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, list | tuple):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=repr
    )


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for name in (
        "region nation customer supplier part orders lineitem events documents embeddings "
        "pages benchmark labels conversations"
    ).split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def compare(df, con, name: str) -> str | None:
    """None when the frame of a query agrees with its SQL, else what differs."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return None if got[1] else "no rows"
    cur = con.execute(ORACLES[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} <> {want[0]}"
    if len(got[1]) != len(want[1]):
        extra = [r for r in got[1] if r not in set(want[1])][:2]
        missing = [r for r in want[1] if r not in set(got[1])][:2]
        return f"{len(got[1])} rows <> {len(want[1])}; only spark {extra}; only sql {missing}"
    for g, w in zip(got[1], want[1], strict=True):
        if g != w:
            return f"{g}\n      <> {w}"
    return None


if __name__ == "__main__":
    from sitemill.session import builder

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        builder("compare", "local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf), 0
    for name in names:
        start = time.time()
        try:
            diff = compare(QUERIES[name](spark, sf), con, name)
        except Exception as e:
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        mark = "rows " if name not in ORACLES and not diff else ("FAIL " if diff else "ok   ")
        bad += bool(diff)
        print(f"{mark} {name} {time.time() - start:.1f}s {diff or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    sys.exit(1 if bad else 0)

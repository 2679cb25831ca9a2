"""Runs a registered query next to its SQL in the comparison engine and compares values, order aside."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(v):
    if isinstance(v, float):
        return ("f", "nan") if math.isnan(v) else ("f", round(v, 6) + 0.0)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, decimal.Decimal):
        return ("d", str(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return ("t", v.isoformat())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> list[str]:
    """Problems found; empty when both sides agree."""
    names, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return [f"columns {names} != {want_names}"]
    problems = []
    if got != want:
        problems.append(f"rows {sum(got.values())} vs {sum(want.values())}")
        problems += [f"only spark {r} x{n}" for r, n in list((got - want).items())[:3]]
        problems += [f"only sql   {r} x{n}" for r, n in list((want - got).items())[:3]]
    if not want:
        problems.append("no rows on either side")
    return problems

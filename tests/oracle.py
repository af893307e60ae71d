"""Compare a query with its SQL in DuckDB over the same tables."""

from __future__ import annotations

import datetime
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if x != x else x + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return float(x) if type(x).__name__ == "Decimal" else x


def same(spark_df, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    names = sorted(spark_df.columns)
    rel = con.sql(sql)
    if names != sorted(rel.columns):
        return f"columns {names} and {sorted(rel.columns)}"
    # Doubles are sorted after all else, and coarsely, so that the last digits do not decide which rows meet.
    key = lambda r: ([(v is None, str(v)) for v in r if not isinstance(v, float)], [(v is None, round(v, 4)) for v in r if isinstance(v, float)])
    got = sorted(([plain(v) for v in r] for r in spark_df.select(*names).collect()), key=key)
    want = sorted(([plain(v) for v in r] for r in rel.select(*[f'"{n}"' for n in names]).fetchall()), key=key)
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            close = isinstance(x, float) and isinstance(y, (float, int)) and abs(x - y) <= max(1e-12, 1e-9 * abs(x))
            if x != y and not close:
                return f"{names}: {a} and {b}"
    return ""

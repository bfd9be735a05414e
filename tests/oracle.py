"""Compare a query with its SQL on the same files."""

import duckdb
import numpy as np

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, float) and value != value:
        return "nan"
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(plain, key=repr)


def difference(df, con, sql):
    """None when both give the same rows, else a short description."""
    result = con.execute(sql)
    want_columns, want = _rows([d[0] for d in result.description], result.fetchall())
    have_columns, have = _rows(df.columns, [tuple(r) for r in df.collect()])
    if have_columns != want_columns:
        return f"columns {have_columns} != {want_columns}"
    if len(have) != len(want):
        return f"{len(have)} rows, SQL gives {len(want)}; {have[:2]} / {want[:2]}"
    wrong = [(h, w) for h, w in zip(have, want) if h != w or [type(x) for x in h if x is not None] != [type(x) for x in w if x is not None]]
    return f"{len(wrong)} of {len(want)} rows differ, as {wrong[0]}" if wrong else None

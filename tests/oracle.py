"""Compare a query with its SQL in DuckDB, as bags of rows."""

import os

import duckdb

SF = "/root/testdata/sf0.001"
HAVE = os.path.isdir(SF)


def shown(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(int(v)))
    if isinstance(v, float):
        return (1, f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return (1, str([shown(x) for x in v]))
    return (1, str(v))


def rows_of(columns, rows, keep):
    at = [columns.index(c) for c in keep]
    return sorted(tuple(shown(r[i]) for i in at) for r in rows)


def check(spark, query, sql, whole=True):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    want = con.sql(sql)
    df = query(spark, SF)
    if whole:
        assert sorted(df.columns) == sorted(want.columns)
    keep = sorted(want.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()], keep) == rows_of(want.columns, want.fetchall(), keep)

"""Result of a query against that of SQL in DuckDB, as sorted rows."""

import glob
import math
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def plain(x):
    if x is None:
        return None
    if isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (bool, str)):
        return x
    return float(x) + 0.0 if isinstance(x, float) or hasattr(x, "as_integer_ratio") and not isinstance(x, int) else int(x)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def same(df, con, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.sql(sql)
    want = rows(found.columns, found.fetchall())
    assert sorted(df.columns) == sorted(found.columns)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    wrong = {c: (t, str(k)) for (c, t) in df.dtypes for d, k in zip(found.columns, found.types) if d == c and kinds.get(t) != str(k)}
    diff = [x for x in zip(got, want) if x[0] != x[1]]
    assert len(got) == len(want) and not diff, (len(got), len(want), diff[:3])
    return wrong

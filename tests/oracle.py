"""Comparison of a query with its SQL in DuckDB."""

import math
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "asDict"):
        v = tuple(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    return v


def compare(spark, data, query, sql):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    df = query(spark, data)
    columns = sorted(df.columns)
    ours = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert ours == theirs

"""Compares a query's rows with DuckDB's, as multisets over columns by name."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else int(v) if v == int(v) and abs(v) < 1e15 else round(v, 9)
    return v


def same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    theirs = sorted((tuple(norm(r[names.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    ours = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    assert ours == theirs
    return len(ours)

"""Runs a DuckDB oracle and compares it with a Spark result, row by row and order-free."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(f"{float(x):.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    done = con.execute(sql)
    names = [c[0] for c in done.description]
    return sorted(names), rows(names, done.fetchall())


def assert_same(df, sql, sf_dir):
    names, want = oracle_rows(sql, sf_dir)
    assert sorted(df.columns) == names
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert a == b, f"\nspark  {a}\noracle {b}"

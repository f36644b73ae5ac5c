"""Holds registered queries against their SQL on DuckDB: columns, rows and values."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same(a, b):
    if a is None or b is None:
        return a is b
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    return a == b


def differences(df, sql, con):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns differ: {sorted(set(names) ^ set(df.columns))}"
    order = sorted(names)
    pick = [names.index(n) for n in order]
    key = lambda r: tuple((x is None, str(x) if not isinstance(x, float) else f"{x:.6g}") for x in r)
    want = sorted((tuple(r[i] for i in pick) for r in want), key=key)
    got = sorted((tuple(r[n] for n in order) for r in df.select(*order).collect()), key=key)
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}"
    bad = [(n, x, y) for g, w in zip(got, want, strict=True) for n, x, y in zip(order, g, w, strict=True) if not same(x, y)]
    return f"{len(bad)} values differ, as {bad[:3]}" if bad else ""

"""Run a query beside its SQL on the same parquet tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 5) + 0.0
    return x


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(x) for x in r) for r in df.select(*(f"`{n}`" for n in names)).collect()), key=repr)


def assert_same(query, sql, spark, sf_dir):
    got_names, got = rows_of_spark(query(spark, sf_dir))
    want_names, want = rows_of_sql(sql, sf_dir)
    assert got_names == want_names
    assert len(got) == len(want)
    assert got == want

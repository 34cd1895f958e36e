"""Rows of a query against DuckDB's."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    return "~" if v is None else str(v)


def compare(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    want = sorted(tuple(plain(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall())
    assert got == want

"""Rows of a Spark query and of a DuckDB query in one form."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(value(r[k]) for k in order) for r in found), key=repr)


def of_spark(df):
    return sorted(df.columns), rows(df.columns, df.collect())


def of_duckdb(con, sql):
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    return sorted(columns), rows(columns, result.fetchall())

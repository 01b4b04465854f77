"""Rows of Spark and of DuckDB in one form."""

import datetime
import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, bool | str):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime | datetime.date):
        return str(value)
    return value


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def of_sql(con, sql):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return canonical(names, cur.fetchall())


def of_frame(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])

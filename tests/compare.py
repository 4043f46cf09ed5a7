"""Side-by-side comparison of a Spark result with its SQL counterpart in DuckDB."""

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    normal = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(normal, key=repr)


def differences(spark_df, con, sql, show=3):
    """Empty when both results agree in columns, rows and values."""
    left_columns, left = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    right_columns, right = table([d[0] for d in cursor.description], cursor.fetchall())
    if left_columns != right_columns:
        return [f"columns {left_columns} / {right_columns}"]
    found = [] if len(left) == len(right) else [f"rows {len(left)} / {len(right)}"]
    if left != right:
        only_left, only_right = sorted(set(left) - set(right), key=repr), sorted(set(right) - set(left), key=repr)
        found += [f"{len(only_left)} values differ", f"spark {only_left[:show]}", f"sql {only_right[:show]}"]
    return found

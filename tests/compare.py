"""Run registered queries and their SQL on one data folder and compare schema and values."""

from __future__ import annotations

import glob
import os
import time
from collections import Counter
from decimal import Decimal

import duckdb

# how a Spark type is called by the second engine
NAMES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "date": "DATE",
    "boolean": "BOOLEAN", "double": "DOUBLE",
}


def connect(root: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{root}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def _plain(value):
    return value.normalize() if isinstance(value, Decimal) else value


def compare(query, sql, spark, root, connection) -> dict:
    started = time.time()
    frame = query(spark, root)
    rows = frame.collect()
    spent = time.time() - started
    answer = connection.execute(sql)
    names = [column[0] for column in answer.description]
    types = {column[0]: str(column[1]) for column in answer.description}
    expected = answer.fetchall()
    order = sorted(frame.columns)
    result = {"rows": len(rows), "sec": round(spent, 2), "problem": None}
    if sorted(names) != order:
        result["problem"] = f"columns {order} against {sorted(names)}"
        return result
    mine = {
        f.name: NAMES.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
        for f in frame.schema.fields
    }
    different = {
        name: (mine[name], types[name]) for name in order
        if mine[name].replace(" ", "") != types[name].replace(" ", "")
    }
    if different:
        result["problem"] = f"types {different}"
    got = Counter(tuple(_plain(row[name]) for name in order) for row in rows)
    position = [names.index(name) for name in order]
    want = Counter(tuple(_plain(row[i]) for i in position) for row in expected)
    if got != want:
        only_got, only_want = got - want, want - got
        result["problem"] = (
            f"values: {sum(got.values())} against {sum(want.values())} rows; only Spark: "
            f"{list(only_got.items())[:2]}; only SQL: {list(only_want.items())[:2]}"
        )
    return result

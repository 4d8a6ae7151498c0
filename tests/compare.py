"""Run registered queries and their SQL side by side:  python -m tests.compare FOLDER [NAME ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from tickerloom.plans import oracles
from tickerloom.plans.queries import QUERIES, TABLES
from tickerloom.session import local_session


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return repr(value)
    return str(value)


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def difference(spark, con, folder: str, name: str, sql: str) -> str:
    """Empty if both results hold the same columns and rows, else what differs."""
    frame = QUERIES[name](spark, folder)
    columns, ours = _bag(frame.columns, frame.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    other_columns, theirs = _bag(names, result.fetchall())
    if columns != other_columns:
        return f"columns {columns} / {other_columns}"
    if ours != theirs:
        only_ours, only_theirs = list((ours - theirs).items()), list((theirs - ours).items())
        return (f"rows {sum(ours.values())} / {sum(theirs.values())}; columns {columns}; "
                f"{len(only_ours)} only in Spark {sorted(only_ours, key=str)[:3]}; "
                f"{len(only_theirs)} only in SQL {sorted(only_theirs, key=str)[:3]}")
    return "" if ours else "empty"


if __name__ == "__main__":
    folder, chosen = sys.argv[1], sys.argv[2:]
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    connection, sqls, bad = connect(folder), oracles.build(), 0
    for key in chosen or QUERIES:
        began = time.time()
        try:
            if key in sqls:
                outcome = difference(session, connection, folder, key, sqls[key]) or "ok"
            else:
                outcome = f"no SQL, {QUERIES[key](session, folder).count()} rows"
        except Exception as error:  # report and go on with the next query
            outcome = f"ERROR {type(error).__name__} {str(error)[:1500]}"
        bad += not (outcome == "ok" or outcome.startswith("no SQL"))
        print(f"{key:32s} {time.time() - began:6.1f}s  {outcome}", flush=True)
    print("bad:", bad)

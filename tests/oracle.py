"""Compare a registered query with its SQL on the same Parquet files."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, (np.ndarray, list, tuple)):
        return tuple(_cell(v) for v in value)
    if isinstance(value, (float, np.floating)):
        return None if math.isnan(value) else float(value)
    if value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, (np.integer, np.bool_)):
        return value.item()
    return value


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    cells = [[_cell(v) for v in frame[c].tolist()] for c in columns]
    return sorted(zip(*cells, strict=True), key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} / {len(sql_frame)}"
    left, right = rows(spark_frame), rows(sql_frame)
    if left == right:
        return None
    for a, b in zip(left, right, strict=True):
        if a != b:
            return f"{sorted(spark_frame.columns)}: {a} / {b}"
    return None


def main(argv: list[str]) -> int:
    import tracewell.workload as workload
    from tests.conftest import local_session

    folder = argv[0]
    names = [n for n in workload.QUERIES if not argv[1:] or any(p in n for p in argv[1:])]
    spark = local_session()
    con = database(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            frame = workload.QUERIES[name](spark, folder).toPandas()
            took = time.time() - start
            if name in workload.ORACLES:
                problem = difference(frame, con.execute(workload.ORACLES[name]).df())
                state = "ok" if problem is None else "DIFFERS " + problem[:600]
            else:
                problem, state = None, "rows only"
            if len(frame) == 0:
                state += " EMPTY"
        except Exception as error:
            took, problem = time.time() - start, str(error)
            state = "FAILS " + str(error)[:700].replace("\n", " | ")
        failed += problem is not None
        print(f"{name:32s} {took:6.2f}s {len(frame) if problem is None else '-':>8} {state}", flush=True)
    print("failed", failed, "of", len(names))
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

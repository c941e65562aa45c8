"""Run registered queries on both engines and report where the results differ.

    python -m contract.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from contract.oracle import ORACLE
from contract.queries import QUERIES


def open_tables(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return str(v)[:10]
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (int, float)) or hasattr(v, "item"):
        return float(v) + 0.0
    return v


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    rows = [tuple(_plain(v) for v in r) for r in frame[names].itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(spark: SparkSession, con, sf: str, name: str) -> list[str]:
    got = QUERIES[name](spark, sf)
    rel = con.sql(ORACLE[name])
    if sorted(got.columns) != sorted(rel.columns):
        return [f"columns {sorted(got.columns)} != {sorted(rel.columns)}"]
    kinds = dict(zip(rel.columns, (str(t) for t in rel.types), strict=True))
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
            "date": "DATE", "boolean": "BOOLEAN"}
    out = [
        f"type {c}: {t} vs {kinds[c]}" for c, t in got.dtypes if same.get(t) != kinds[c]
    ]
    a, b = rows_of(got.toPandas()), rows_of(rel.df())
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    unlike = [(x, y) for x, y in zip(a, b, strict=False) if x != y]
    if unlike:
        out.append(f"{len(unlike)} rows differ, first {unlike[0]}")
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(ORACLE)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = open_tables(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            found = differences(spark, con, sf, name)
        except Exception as e:  # report and go on with the next query
            found = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(found)
        print(f"{'DIFF' if found else 'ok  '} {name} {time.time() - start:.1f}s", *found, flush=True)
    print(f"{len(names) - bad} of {len(names)} equal; no SQL: {sorted(set(QUERIES) - set(ORACLE))}")


if __name__ == "__main__":
    main()

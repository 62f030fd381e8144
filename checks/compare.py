"""Run queries and their SQL side by side: ``python -m checks.compare SF_DIR [names]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import ORACLE, sql
from checks.queries import QUERIES


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    texts = frame.map(lambda v: "NULL" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) else str(v))
    return texts.sort_values(list(texts.columns)).reset_index(drop=True)


def differences(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """What differs between two results, whatever the order of rows and columns."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    a, b = canonical(left), canonical(right)
    unequal = (a != b).any(axis=1)
    if unequal.any():
        return f"{int(unequal.sum())} of {len(a)} rows\n{a[unequal].head(3).to_dict('records')}\n{b[unequal].head(3).to_dict('records')}"
    return None


def main(sf: str, names: list[str]) -> int:
    spark, con = session(), database(sf)
    bad = 0
    for name in names or list(QUERIES):
        begin = time.time()
        try:
            left = QUERIES[name](spark, sf).toPandas()
            spent = time.time() - begin
            if name not in ORACLE:
                print(f"rows  {name} {len(left)} {spent:.1f}s", flush=True)
                continue
            begin = time.time()
            right = con.execute(sql(name)).df()
            problem = differences(left, right)
            print(f"{'FAIL' if problem else 'ok'}  {name} {len(left)} {spent:.1f}s sql {time.time() - begin:.1f}s {problem or ''}", flush=True)
        except Exception as e:
            problem = str(e)[:1500]
            print(f"ERROR {name} {problem}", flush=True)
        bad += problem is not None
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))

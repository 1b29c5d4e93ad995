"""Run catalog queries in Spark and as SQL and compare the rows: python -m tests.compare sf0.01 [name ...]"""

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True)


def difference(mine: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """None if equal, else what differs."""
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} / {sorted(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    a, b = canonical(mine), canonical(theirs)
    for column in a.columns:
        kinds = (a[column].dtype.kind, b[column].dtype.kind)
        if len(a) and kinds[0] != kinds[1]:
            return f"type of {column}: {a[column].dtype} / {b[column].dtype}"
        same = (a[column] == b[column]) | (a[column].isna() & b[column].isna())
        if a[column].dtype.kind == "f" and (np.signbit(a[column]) != np.signbit(b[column])).any():
            return f"sign of zero in {column}"
        if not same.all():
            at = same[~same].index[0]
            return f"{column}, {int((~same).sum())} rows, first {a.loc[at].to_dict()} / {b.loc[at].to_dict()}"
    return None


def main(scale: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as driver

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/{scale}"
    con, sql, failed = connect(folder), driver.oracle_sql(), 0
    for name, run in driver.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            mine = run(spark, folder).toPandas()
            took = time.time() - start
            start = time.time()
            verdict = difference(mine, con.execute(sql[name]).df()) if name in sql else "no SQL"
            print(f"{'ok  ' if verdict is None else 'DIFF'} {name} {len(mine)} rows {took:.1f}s sql {time.time() - start:.1f}s {verdict or ''}", flush=True)
            failed += verdict is not None
        except Exception as error:  # report and go on with the next query
            print(f"FAIL {name} {str(error)[:500]}", flush=True)
            failed += 1
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))

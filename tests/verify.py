"""Runs every query against its SQL in DuckDB: python tests/verify.py FOLDER [NAME...]"""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].map(lambda x: None if x is None or x != x else f"{float(x):.5f}" if isinstance(x, (int, float)) or type(x).__name__ in ("Decimal", "float64", "int64", "int32", "float32") else str(x))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, query, sql: str, folder: str) -> str:
    got, want = canonical(query(spark, folder).toPandas()), canonical(con.sql(sql).df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} {list(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} {len(want)}"
    off = (got.fillna("") != want.fillna("")).any(axis=1)
    return f"{off.sum()} of {len(got)} rows differ: {got[off].head(2).to_dict('records')} {want[off].head(2).to_dict('records')}" if off.any() else ""


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


if __name__ == "__main__":
    from pairlens.queries import QUERIES, SQL

    folder = sys.argv[1]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in sys.argv[2:] or QUERIES:
        try:
            said = compare(spark, con, QUERIES[name], SQL[name], folder) if name in SQL else f"rows only: {QUERIES[name](spark, folder).count()}"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:400]}"
        bad += bool(said) and not said.startswith("rows only")
        if said:
            print(name, said, flush=True)
    print("queries", len(QUERIES), "with SQL", len(SQL), "bad", bad)

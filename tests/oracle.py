"""Run registered queries and their SQL side by side and compare the rows.

    python -m tests.oracle [sf_dir] [name ...]
"""

import datetime
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def local_session(name: str, cores: int = 8) -> SparkSession:
    session = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "NaN" if math.isnan(x) else repr(x + 0.0)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    return repr(x)


def normal_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str:
    """Empty text when columns and rows agree; otherwise what differs."""
    df = fn(spark, sf_dir)
    got = normal_rows(df.columns, df.collect())
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    want = normal_rows(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    if got != want:
        extra, lacking = set(got) - set(want), set(want) - set(got)
        return (f"{len(got)} rows against {len(want)}; {len(extra)} extra {sorted(extra)[:2]}; "
                f"{len(lacking)} lacking {sorted(lacking)[:2]}")
    return "" if got else "no rows"


def main(argv: list[str]) -> int:
    from quoinlake.plans.catalog import QUERIES, SQL

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con, bad = local_session("compare"), duck(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            if name in SQL:
                problem = compare(spark, con, QUERIES[name], SQL[name], sf_dir)
            else:
                problem = "" if QUERIES[name](spark, sf_dir).count() else "no rows"
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:26s} {time.time() - start:6.2f}s {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))

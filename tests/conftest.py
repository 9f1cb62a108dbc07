import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))  # for Spark's Python workers

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def normal(value) -> str:
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


def rows_of(df) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())


def oracle_rows(sql: str, data: str = DATA) -> tuple[list[str], list[tuple]]:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    got = con.sql(sql)
    columns = sorted(got.columns)
    at = [got.columns.index(c) for c in columns]
    return columns, sorted(tuple(normal(r[i]) for i in at) for r in got.fetchall())

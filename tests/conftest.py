import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config(map={"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return SF


def norm(x):
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(norm(v) for v in x)
    return round(x, 6) if isinstance(x, float) else x


@pytest.fixture(scope="session")
def same_as_sql(spark, sf):
    """Runs a query and its SQL and compares columns and rows, whatever their order."""
    import duckdb

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def check(query, sql):
        df = query(spark, sf)
        got = df.collect()
        cur = con.execute(sql)
        cols = [c[0] for c in cur.description]
        want = cur.fetchall()
        assert sorted(cols) == sorted(df.columns)
        order = sorted(cols)
        a = sorted((tuple(norm(r[df.columns.index(c)]) for c in order) for r in got), key=repr)
        b = sorted((tuple(norm(r[cols.index(c)]) for c in order) for r in want), key=repr)
        assert a == b

    return check

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def canonical(rows):
    """Rows as sorted tuples of text: floats to nine digits."""

    def one(v):
        if v is None or v != v:
            return "NULL"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.fixture(scope="session")
def same(spark, duck, sf):
    """Asserts that a query and its SQL give the same rows."""

    def check(query, sql):
        df = query(spark, sf)
        names = sorted(df.columns)
        found = canonical(tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect())
        rel = duck.sql(sql)
        assert names == sorted(rel.columns)
        order = [rel.columns.index(n) for n in names]
        assert found == canonical(tuple(r[i] for i in order) for r in rel.fetchall())

    return check

"""One local session for all tests; a compare helper for queries with SQL."""

from __future__ import annotations

import glob
import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{shared}").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return repr(value)


def same_as_sql(spark, query, sql, folder=DATA):
    """Run a query and its SQL over a folder and compare names and rows."""
    import duckdb

    with duckdb.connect() as c:
        for f in glob.glob(f"{folder}/*.parquet"):
            c.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
        cursor = c.execute(sql)
        names = [d[0] for d in cursor.description]
        wanted = sorted(tuple(plain(v) for _, v in sorted(zip(names, row, strict=True))) for row in cursor.fetchall())
    df = query(spark, folder)
    assert sorted(df.columns) == sorted(names)
    found = sorted(tuple(plain(row[k]) for k in sorted(df.columns)) for row in df.collect())
    assert found == wanted


@pytest.fixture
def rows(spark):
    """Rows of a DataFrame as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)

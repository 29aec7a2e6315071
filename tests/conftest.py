"""A Spark session for all tests, and DuckDB over a directory of the driver's tables."""

from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="likeloom-tests-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false; SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(found, columns):
    """Rows in no order, doubles to nine digits."""

    def plain(v):
        return None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(([plain(x) for x in r] for r in found), key=str)


@pytest.fixture(scope="session")
def same(spark, sf_dir, duck):
    """Asserts that a query gives what its SQL gives."""

    def check(query, sql):
        df = query(spark, sf_dir)
        columns = sorted(df.columns)
        ours = rows([tuple(r) for r in df.select(*columns).collect()], columns)
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        theirs = rows([[r[i] for i in at] for r in result.fetchall()], columns)
        assert ours == theirs

    return check

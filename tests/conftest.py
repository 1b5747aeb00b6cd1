"""One session for all tests; helpers that hold a query against its SQL."""

from __future__ import annotations

import hashlib
import math
import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("TZ", "UTC")

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    """A value in a form that both engines share."""
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, (bytes, bytearray)):
        return hashlib.sha256(bytes(value)).hexdigest()
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return [plain(x) for x in value]
    if type(value).__name__ == "Decimal":
        return f"{float(value):.6g}"
    if hasattr(value, "isoformat"):
        return value.isoformat(" ")[:26]
    return plain(value.item()) if hasattr(value, "item") else str(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def against_sql(df, con, sql):
    """Both results have the same columns and the same rows."""
    spark_columns, spark_rows = sorted_rows(df.columns, df.collect())
    cursor = con.execute(sql)
    duck_columns, duck_rows = sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    assert spark_columns == duck_columns
    assert len(spark_rows) == len(duck_rows)
    different = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b]
    assert not different, different[:3]

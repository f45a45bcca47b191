from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return str(DATA)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def same_rows():
    """Spark's rows and an oracle's, whatever their order."""

    import pandas as pd

    def value(v):
        return None if v is None or pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v.item() if hasattr(v, "item") else v

    def check(ours, theirs):
        assert sorted(ours.columns) == sorted(theirs.columns)
        columns = sorted(ours.columns)
        rows = [sorted(map(repr, (tuple(map(value, r)) for r in x[columns].astype(object).itertuples(index=False)))) for x in (ours, theirs)]
        assert rows[0] == rows[1]

    return check

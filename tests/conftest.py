from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "")])
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("test tables are not here")
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def rows_of(frame):
    """Rows as sorted tuples of text, columns by name; floats to 6 digits."""
    import numpy as np
    import pandas as pd

    def cell(v):
        if isinstance(v, (list, tuple, np.ndarray)):
            return str([cell(x) for x in v])
        if v is None or pd.isna(v):
            return ""
        if isinstance(v, (bool, np.bool_)):
            return str(float(v))
        return f"{float(v):.6g}" if isinstance(v, (int, float, np.number)) else str(v)

    cols = sorted(frame.columns)
    return cols, sorted(tuple(map(cell, r)) for r in frame[cols].itertuples(index=False))

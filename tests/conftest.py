import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def root():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    d = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        d.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return d


def _cell(v):
    import numbers

    import numpy as np
    import pandas as pd

    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return f"{round(float(v), 6) + 0.0:.6f}" if isinstance(v, numbers.Number) else str(v)


def rows_of(frame):
    """Order-free rows with columns by name and numbers rounded, for comparing engines."""
    names = sorted(frame.columns)
    return names, sorted((tuple(map(_cell, rec)) for rec in frame[names].astype(object).values.tolist()), key=str)

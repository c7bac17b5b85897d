import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from tessera.session import session

    spark = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    """A value that compares alike whichever engine it comes from."""
    import numpy as np
    import pandas as pd

    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in value)
    if isinstance(value, (bool, np.bool_, str)):
        return value if isinstance(value, str) else bool(value)
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return None
    if isinstance(value, (int, float, np.integer, np.floating)):
        return float(f"{float(value):.9g}")
    return str(value)


@pytest.fixture(scope="session")
def same():
    """Compares two pandas frames as bags of rows."""

    def rows(frame):
        frame = frame[sorted(frame.columns)]
        return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)

    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        assert rows(a) == rows(b)

    return check

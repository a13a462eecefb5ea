import os
import sys

import pytest

from helpers import DATA

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quire.session import session

    s = session("local[4]", partitions=4, spark__checkpoint__dir="file://" + str(tmp_path_factory.mktemp("shared")), spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """sf -> a DuckDB connection with the tables of /root/testdata/<sf> as views."""
    import duckdb

    def connect(sf: str):
        con = duckdb.connect()
        for name in os.listdir(f"{DATA}/{sf}"):
            path = f"{DATA}/{sf}/{name}"
            con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
        return con

    return connect

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from cyclewise.session import get_session

    s = get_session("local[4]", conf={"spark.sql.shuffle.partitions": "8", "spark.default.parallelism": "4"})
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from cyclewise.sources.tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con

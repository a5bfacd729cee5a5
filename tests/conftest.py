import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("OMP_NUM_THREADS", "1")

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from touchline.session import local_session

    session = local_session(4, memory="6g", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def comparable(columns, rows):
    """Rows as sorted lists with columns by name and doubles rounded."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)

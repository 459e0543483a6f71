import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from memloom.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cpus=os.environ.get("TEST_CPUS", "4"), spark_sql_shuffle_partitions="4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    folder = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    if not folder.exists():
        pytest.skip("no test data here")
    return str(folder)

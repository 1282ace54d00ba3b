import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tallyloom.session import get_session

    session = get_session("tests", "local[8]", 4, **{
        "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.sql.warehouse.dir": _warehouse()})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _warehouse():
    import tempfile
    return tempfile.mkdtemp(prefix="tallyloom-warehouse-")


@pytest.fixture(scope="session")
def data():
    return DATA

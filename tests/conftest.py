import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from opslens.session import build_session  # noqa: E402
from opslens.streaming.alerts import ROCKSDB  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                            spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
                            spark__sql__streaming__stateStore__providerClass=ROCKSDB)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """DataFrame of tuples with a DDL schema."""
    def make(data, schema):
        return spark.createDataFrame(data, schema)
    return make


def tuples(df):
    return [tuple(r) for r in df.collect()]

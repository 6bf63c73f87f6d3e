import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from washline.session import local_session

    session = local_session("*", "washline-tests", **{"spark.sql.shuffle.partitions": "8"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    from washline import staging

    staging.release(session)
    session.stop()


@pytest.fixture
def values(spark):
    """Cells of one column, in the order of the key."""

    def read(df, column, key=None):
        rows = df.orderBy(key) if key else df
        return [r[0] for r in rows.select(column).collect()]

    return read

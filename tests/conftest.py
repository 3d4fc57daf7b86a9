import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hostweave.session import local_session  # noqa: E402

T0 = datetime(2024, 5, 1, 10, 0, 0)


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def log(spark):
    """Events from (seconds after T0, type verb, subject, object) in input order."""
    def build(*rows):
        return spark.createDataFrame(
            [(i, T0 + timedelta(seconds=s), f"EVENT_{kind}", subject, target)
             for i, (s, kind, subject, target) in enumerate(rows)],
            "ordinal bigint, ts timestamp_ntz, type string, subject string, object string")
    return build


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())

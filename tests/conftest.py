import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "tests",
        4,
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.sql.timeType.enabled": "true",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    yield session
    session.stop()


def rows(df, *order):
    """Rows as tuples, sorted with NULLs first."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: [(v is not None, v if not isinstance(v, bool) else int(v)) for v in r])


def day(text):
    return dt.date.fromisoformat(text)

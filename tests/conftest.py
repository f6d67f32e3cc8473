import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cartlytics.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app="cartlytics-tests", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


def rows(df, *cols):
    """Collect selected columns as sorted tuples."""
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)

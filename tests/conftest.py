import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from attestry.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *columns):
    """Sorted tuples of a result."""
    out = [tuple(r[c] for c in (columns or df.columns)) for r in df.collect()]
    return sorted(out, key=lambda r: [(v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r])

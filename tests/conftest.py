from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from rankforge.session import local_session

    session = local_session(8, partitions=4, app="tests")
    yield session
    session.stop()


def as_set(df, *cols):
    """Rows as a sorted list of tuples of plain values."""
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())

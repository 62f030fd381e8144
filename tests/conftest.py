import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checks.compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    yield session("4")


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples."""
    return lambda df, *columns: sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)

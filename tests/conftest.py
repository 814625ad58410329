import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from plumbline.session import local_session

    session = local_session("8", "plumbline-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def rows():
    def collect(df, *columns):
        return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())

    return collect

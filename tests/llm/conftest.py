import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from plumbline.session import local_session

    session = local_session("8", "plumbline-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, value string"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents from (doc_id, text[, source]) with extra columns whose names operators use inside."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1.0, "r", "v") for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make

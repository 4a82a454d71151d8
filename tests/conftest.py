import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sqlstrata.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", "8g")


@pytest.fixture
def corpus(spark):
    """Texts to a corpus of one row per text; the doc id is the position."""
    def make(*texts, path=None):
        return spark.createDataFrame([(i, path or f"f{i}.sql", t) for i, t in enumerate(texts)], "doc_id int, path string, sql string")
    return make

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fitlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture
def tiny_chunks(spark):
    """Cut every run into chunks of a few rows, as a very long run would be."""
    spark.conf.set("spark.fitlake.chunkRows", "7")
    yield 7
    spark.conf.unset("spark.fitlake.chunkRows")

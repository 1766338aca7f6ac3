"""Registered text queries: against their SQL, and the entry guard."""

import subprocess
import sys

import pytest

from fitlake.llm.queries import QUERIES, SQL
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, name):
    if SQL[name] is not None:
        assert compare(QUERIES[name](spark, SF), duck(SF), SQL[name]) is None


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {"pipeline", *(f"op{i}" for i in range(1, 14))}


def test_entry_without_text_operators():
    code = ("import sys; sys.modules['fitlake.llm.queries'] = None; import __spark_entry__ as e; "
            "assert 'pipeline' not in e.queries() and len(e.queries()) > 100")
    assert subprocess.run([sys.executable, "-c", code], cwd=SF.replace(SF, "."), capture_output=True).returncode == 0

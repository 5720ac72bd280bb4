"""The operators that SQL can express, against DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from gridframe.llm.catalog import ORACLE_SQL, QUERIES  # noqa: E402
from oracle_compare import compare  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", [name], verbose=False)[name][0] == "ok"


def test_one_query_per_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))

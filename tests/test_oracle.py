"""Every catalogue query against its DuckDB oracle on sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from gridframe.plans.catalog import ORACLE_SQL, QUERIES  # noqa: E402
from oracle_compare import compare  # noqa: E402

from conftest import SF_SMALL  # noqa: E402


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF_SMALL, [name], verbose=False)
    status = res[name][0]
    if name in entry.oracle_sql():
        assert status == "ok", f"{name}: {res[name]}"
    else:
        assert status == "rows-only"


def test_every_query_has_an_oracle():
    assert set(ORACLE_SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())

"""Every training-data query with a DuckDB statement gives the same rows."""

from __future__ import annotations

import pytest

from quern.llm import queries, sql
from tests import sqlcheck

pytestmark = pytest.mark.skipif(not sqlcheck.DATA.exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_same_rows(spark, name):
    sqlcheck.compare(spark, queries.queries()[name], sql.SQL[name])

"""Every core query with a DuckDB statement gives the same rows."""

from __future__ import annotations

import pytest

from quern.plans import registry
from tests import sqlcheck

pytestmark = pytest.mark.skipif(not sqlcheck.DATA.exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    sqlcheck.compare(spark, registry.queries()[name], registry.oracle_sql()[name])

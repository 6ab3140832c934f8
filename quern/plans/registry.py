"""All registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import core

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "amounts_by_unit"


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in core.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in core.QUERIES.items() if sql}

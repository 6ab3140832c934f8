"""The registered queries of this subpackage: name -> (spark, data folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import canon, copies, cross, cutoff, garbled, leaks, lookalike, mixing, near

Query = Callable[[SparkSession, str], DataFrame]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/training_rows.parquet")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = _table(spark, sf_dir, "mix_targets")
    return mixing.choose(mixing.counted(_table(spark, sf_dir, "documents")), targets), targets


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: copies.found(_rows(s, d)),
        "p1_records": lambda s, d: copies.collapse(_rows(s, d)),
        "p2_found": lambda s, d: near.found(_rows(s, d)),
        "p2_groups": lambda s, d: near.groups(_rows(s, d)),
        "p3_method": lambda s, d: lookalike.consistent(_rows(s, d), strict=True).select("id", "form"),
        "p3_found": lambda s, d: lookalike.found(_rows(s, d)),
        "p3_forms": lambda s, d: lookalike.consistent(_rows(s, d)).select("id", "form"),
        "p4_found": lambda s, d: garbled.found(_rows(s, d)),
        "p4_repaired": lambda s, d: garbled.repaired(_rows(s, d)),
        "p6_found": lambda s, d: canon.found(_table(s, d, "ingredient_texts"), _table(s, d, "fdc_ingredients")),
        "p6_unmatched": lambda s, d: canon.unmatched(_table(s, d, "ingredient_texts"), _table(s, d, "fdc_ingredients")),
        "p7_method": lambda s, d: cross.edit_pairs(_rows(s, d)),
        "p7_found": lambda s, d: cross.found(_rows(s, d)),
        "p7_report": lambda s, d: cross.report(_rows(s, d)),
        "p8_found": lambda s, d: leaks.found(_table(s, d, "documents"), _table(s, d, "eval_items")),
        "p8_items": lambda s, d: leaks.report(_table(s, d, "documents"), _table(s, d, "eval_items"), max_cover=0.8),
        "p8_cleaned": lambda s, d: leaks.cleaned(_table(s, d, "documents"), _table(s, d, "eval_items"), max_cover=0.8),
        "p9_mix": lambda s, d: _mix(s, d)[0],
        "p9_shares": lambda s, d: mixing.shares(*_mix(s, d)),
        "p10_found": lambda s, d: cutoff.found(_table(s, d, "documents")),
        "p10_sources": lambda s, d: cutoff.report(_table(s, d, "documents")),
    }

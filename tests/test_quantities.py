"""Amounts in common units."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import quantities as q

UNITS = [("gram", "mass", 1.0), ("kilogram", "mass", 1000.0), ("ounce", "mass", 28.349523125), ("pound", "mass", 453.59237), ("milliliter", "volume", 1.0), ("liter", "volume", 1000.0), ("teaspoon", "volume", 4.92892159375), ("tablespoon", "volume", 14.78676478125), ("fluid_ounce", "volume", 29.5735295625), ("cup", "volume", 236.5882365), ("pint", "volume", 473.176473), ("imperial_pint", "volume", 568.26125)]
AMOUNT = "amount_id long, recipe_id long, line_no int, source string, quantity string, quantity_max string, unit string, text string, loaded_at timestamp, extra string"
COMPOSITE = "amount_id long, recipe_id long, line_no int, source string, amounts array<struct<quantity:string,unit:string,text:string>>, is_subtractive boolean, loaded_at timestamp"


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(UNITS, "unit string, dimension string, factor_to_base double")


def common(spark, units, rows, parts=()):
    a = spark.createDataFrame([(i, r, n, "s", *x, None, "e") for i, (r, n, *x) in enumerate(rows, 1)], AMOUNT)
    c = spark.createDataFrame([(100 + i, r, n, "s", p, m, None) for i, (r, n, p, m) in enumerate(parts)], COMPOSITE)
    return q.common_amounts(a, c, units)


@pytest.mark.parametrize(("fields", "want"), [
    (("1 1/2", None, "cup", None), ("volume", 354.88235475, 354.88235475)),
    (("1½", "1½", "Cups", None), ("volume", 354.88235475, 354.88235475)),
    (("1#1$2 kg", None, None, None), ("mass", 1500.0, 1500.0)),
    ((None, None, None, "about 1.5kg"), ("mass", 1500.0, 1500.0)),
    ((None, None, "", "(~two and a half lb.)"), ("mass", 1133.980925, 1133.980925)),
    (("1,75", "1,75", "L", None), ("volume", 1750.0, 1750.0)),
    (("1,750", None, "g", None), ("mass", 1750.0, 1750.0)),
    (("2", "4", "oz", None), ("mass", 56.69904625, 113.3980925)),
    (("2–4", None, "oz", None), ("mass", 56.69904625, 113.3980925)),
    (("4 to 2", None, "oz", None), ("mass", 56.69904625, 113.3980925)),
    (("2", None, "T", None), ("volume", 29.5735295625, 29.5735295625)),
    (("2", None, "t", None), ("volume", 9.8578431875, 9.8578431875)),
    (("1", None, "imp. pt", None), ("volume", 568.26125, 568.26125)),
    (("1", None, "UK fl oz", None), ("volume", 29.5735295625, 29.5735295625)),
    (("1", None, "US pint", None), ("volume", 473.176473, 473.176473)),
    (("7/2", None, "kilograms", None), ("mass", 3500.0, 3500.0)),
    (("1", None, "tabelspoon", None), ("volume", 14.78676478125, 14.78676478125)),
    (("3", None, "pinch", None), None), (("3", None, "can", None), None), (("3", None, None, "3"), None), ((None, None, "cup", None), None), ((None, None, None, None), None), (("1/0", None, "cup", None), None), (("x" * 5000, None, "cup", None), None),
])
def test_reading(spark, units, fields, want):
    got = common(spark, units, [(1, 1, *fields)]).collect()
    if want is None:
        assert got == []
    else:
        assert (got[0].dimension, got[0].low, got[0].high) == (want[0], pytest.approx(want[1]), pytest.approx(want[2]))


def test_composites(spark, units):
    part = lambda *x: [(a, b, None) for a, b in x]
    rows = [(1, 1, part(("1", "lb"), ("8", "oz")), False), (1, 2, part(("1", "lb"), ("8", "oz")), True), (1, 3, part(("1", "cup"), ("1", "lb")), False), (1, 4, part(("1", "cup"), ("1", "pinch")), False), (1, 5, [], False), (1, 6, None, None), (1, 7, part(("1", "lb"), ("8", "oz")), None)]
    got = {r.line_no: round(r.low, 3) for r in common(spark, units, [], rows).collect()}
    assert got == {1: 680.389, 2: 226.796, 7: 680.389}


def test_latest_delivery_counts(spark, units):
    rows = [(1, 1, 1, "s", "1", None, "g", None, "2024-01-01 00:00:00", "e"), (1, 1, 1, "s", "2", None, "g", None, "2024-02-01 00:00:00", "e"), (1, 1, 1, "s", "3", None, "g", None, None, "e")]
    a = spark.createDataFrame(rows, AMOUNT.replace("loaded_at timestamp", "loaded string")).withColumn("loaded_at", F.to_timestamp("loaded"))
    c = spark.createDataFrame([], COMPOSITE)
    assert [r.low for r in q.common_amounts(a, c, units).collect()] == [2.0]


def test_pairs_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(1, 3), rng.choice([1, 2, None]), "s", rng.choice(["mass", "volume"]), lo, lo * rng.choice([1, 1, 1.01, 1.5])) for i in range(300) for lo in [rng.choice([0.0, 1.0, 1.015, 1.021, 2.0, 100.0, 101.9, 102.1, -3.0])]]
    df = spark.createDataFrame(rows, "amount_id long, recipe_id long, line_no int, source string, dimension string, low double, high double")
    close = lambda a, b: abs(a - b) <= 0.02 * max(abs(a), abs(b)) + 1e-12
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1:3] == b[1:3] and None not in a[1:3] and a[4] == b[4] and close(a[5], b[5]) and close(a[6], b[6])}
    got = [tuple(r) for r in q.equal_amounts(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_empty_and_unresolved(spark, units):
    assert common(spark, units, []).count() == 0 and q.equal_amounts(common(spark, units, [])).count() == 0
    a = spark.createDataFrame([(1, 1, 1, "s", "2", None, "Pinch", None, None, "e"), (2, 1, 1, "s", "2", None, "cup", None, None, "e")], AMOUNT)
    got = q.unresolved_units(a, spark.createDataFrame([], COMPOSITE), units).collect()
    assert [tuple(r) for r in got] == [("pinch", 1)]

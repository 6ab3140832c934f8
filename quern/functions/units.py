"""Canonical units and conversion between them, also between mass and volume."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Units: name, dimension, factor to gram, milliliter or millimeter, other names; fixed values of public definitions.
_UNITS = """
gram|mass|1|g gm gr grams gramme grammes
kilogram|mass|1000|kg kgs kilo kilos kilograms
milligram|mass|0.001|mg milligrams
ounce|mass|28.349523125|oz ounces
pound|mass|453.59237|lb lbs pounds
milliliter|volume|1|ml mL milliliters millilitre millilitres cc
centiliter|volume|10|cl cL centiliters centilitre centilitres
deciliter|volume|100|dl dL deciliters decilitre decilitres
liter|volume|1000|l L liters litre litres
teaspoon|volume|4.92892159375|tsp tsps teaspoons
tablespoon|volume|14.78676478125|tbsp tbsps tbs tb tablespoons
fluid_ounce|volume|29.5735295625|floz fluid_ounces
cup|volume|236.5882365|cups cp
pint|volume|473.176473|pt pts pints
quart|volume|946.352946|qt qts quarts
gallon|volume|3785.411784|gal gals gallons
imperial_fluid_ounce|volume|28.4130625|imperial_floz
imperial_cup|volume|284.130625|
imperial_pint|volume|568.26125|
imperial_quart|volume|1136.5225|
imperial_gallon|volume|4546.09|
millimeter|length|1|mm millimeters millimetre millimetres
centimeter|length|10|cm centimeters centimetre centimetres
inch|length|25.4|in inches
foot|length|304.8|feet ft
"""
_ROWS = [line.split("|") for line in _UNITS.strip().splitlines()]
FACTORS = {n: (d, float(f)) for n, d, f, _ in _ROWS}
ALIASES = {a: n for n, _, _, names in _ROWS for a in (n, *names.split())}

# Words that are no measures although a registry of units might read them so; fixed values.
NO_MEASURES = "pinch pinches bar bars link links shake shakes tin tins unit units fat".split()
# Rewrites of whole words before a unit is looked up; fixed values.
_REWRITES = [
    (r"\bfl oz\b", "floz"), (r"\bfluid oz\b", "fluid_ounce"), (r"\bfl ounce\b", "fluid_ounce"), (r"\bfluid ounce\b", "fluid_ounce"), (r"\bC\b", "cup"),
    (r"\bc\b", "cup"), (r"\bqt\b", "quart"), (r"\bCl\b", "centiliter"), (r"\bG\b", "gram"), (r"\bMl\b", "milliliter"), (r"\bMm\b", "millimeter"),
    (r"\bPt\b", "pint"), (r"\bTb\b", "tablespoon"),
]
_COMPILED = [(re.compile(a), b) for a, b in _REWRITES]
_IMPERIAL = ("cup", "floz", "fluid_ounce", "quart", "pint", "gallon")


def canonical_name(unit: str, imperial: bool = False) -> str | None:
    """The canonical name of a unit as it is written, None if it is no measure."""
    if not unit or "-" in unit or unit.lower() in NO_MEASURES:
        return None
    for pattern, name in _COMPILED:
        unit = pattern.sub(name, unit)
    known = ALIASES.get(unit) or ALIASES.get(unit.lower() if len(unit) > 1 else unit)
    return f"imperial_{known}" if imperial and known in _IMPERIAL else known


def canonical(c: Column, imperial: bool = False) -> Column:
    """``canonical_name`` as an expression."""
    kept = c
    for pattern, name in _REWRITES:
        c = F.regexp_replace(c, pattern, name)
    table = F.create_map(*[F.lit(x) for p in ALIASES.items() for x in p])
    known = F.coalesce(F.try_element_at(table, c), F.when(F.length(c) > 1, F.try_element_at(table, F.lower(c))))
    if imperial:
        known = F.when(known.isin(*_IMPERIAL), F.concat(F.lit("imperial_"), known)).otherwise(known)
    return F.when(~kept.contains("-") & ~F.lower(kept).isin(NO_MEASURES), known)


def unit_table(spark: SparkSession) -> DataFrame:
    """``unit, dimension, factor``: some two dozen rows."""
    return spark.createDataFrame([(n, d, f) for n, (d, f) in FACTORS.items()], "unit string, dimension string, factor double")


def _known(c: Column, what: int) -> Column:
    table = F.create_map(*[F.lit(x) for n, v in FACTORS.items() for x in (n, v[what])])
    return F.try_element_at(table, c)


def converted(value: Column, unit: Column, to: Column, density: Column | float = 1.0) -> Column:
    """``value`` of canonical ``unit`` in canonical ``to``; null if it cannot be.

    Mass and volume convert through ``density`` in g/ml (1000 kg/m3 is 1).
    """
    d = density if isinstance(density, Column) else F.lit(density)
    a, b = _known(unit, 0), _known(to, 0)
    base = value * _known(unit, 1)
    moved = F.when(a == b, base).when((a == "volume") & (b == "mass"), base * d).when((a == "mass") & (b == "volume"), F.try_divide(base, d))
    return moved / _known(to, 1)


def combined(parts: Column, to: Column, subtractive: Column, density: float = 1.0) -> Column:
    """Sum of ``array<struct<value, unit>>`` in ``to``, or the first less the others; null if a part does not convert."""
    signed = F.transform(parts, lambda p, i: F.when(subtractive & (i > 0), -1).otherwise(1) * converted(p["value"], p["unit"], to, density))
    return F.when(F.size(parts) > 0, F.aggregate(signed, F.lit(0.0), lambda a, x: a + x))

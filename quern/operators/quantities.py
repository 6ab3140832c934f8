"""Recorded amounts in common units.

Numbers in any notation become exact decimals with Column expressions.  Unit
spellings are resolved once each: every distinct spelling is looked up in an
inverted index of character n-grams over the known names, the candidates are
verified by a weighted edit distance, and the resulting alias table is joined
to all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.runtime import bucket_pairs, lookup, materialise, with_values

#: A spelling reads as a name if its weighted edits are at most this share of its length.
MOST_EDITS = 0.25

# Names of the units by which spellings are resolved; fixed values.  One-letter names depend on case.
NAMES = {
    "gram": ["g", "G", "gm", "gr", "gram", "grams"],
    "kilogram": ["kg", "kgs", "kilo", "kilos", "kilogram", "kilograms"],
    "milligram": ["mg", "milligram", "milligrams"],
    "ounce": ["oz", "ounce", "ounces"],
    "pound": ["lb", "lbs", "pound", "pounds"],
    "milliliter": ["ml", "cc", "milliliter", "milliliters", "millilitre", "millilitres"],
    "centiliter": ["cl", "centiliter", "centiliters", "centilitre", "centilitres"],
    "deciliter": ["dl", "deciliter", "deciliters", "decilitre", "decilitres"],
    "liter": ["l", "L", "ltr", "liter", "liters", "litre", "litres"],
    "teaspoon": ["t", "tsp", "tsps", "teaspoon", "teaspoons"],
    "tablespoon": ["T", "tb", "tbs", "tbsp", "tbsps", "tablespoon", "tablespoons"],
    "fluid_ounce": ["fl oz", "floz", "fl ounce", "fl ounces", "fluid oz", "fluid ounce", "fluid ounces"],
    "cup": ["c", "C", "cup", "cups"],
    "pint": ["pt", "pts", "pint", "pints"],
    "quart": ["qt", "qts", "quart", "quarts"],
    "gallon": ["gal", "gals", "gallon", "gallons"],
}
# Words before a unit that tell its system; fixed values.
IMPERIAL, US = ("imp", "imperial", "uk", "british"), ("us", "u s", "american")

# Numbers in words; fixed values.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
).split()
# Fraction signs; fixed values.
FRACTIONS = {"¼": "1/4", "½": "1/2", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5", "⅙": "1/6", "⅚": "5/6", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}

_NUM = r"(?:\d+\s+\d+/\d+|\d+/\d+|\d*\.\d+|\d+\.?)"
_AMOUNT = rf"^({_NUM})\s*(?:(?:-|to|or)\s*({_NUM}))?\s*(.*)$"


def _let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once, outside generated code, which long chains would make too large."""
    return F.element_at(F.transform(F.array(c), f), 1)


def plain_number(c: Column) -> Column:
    """Amount text with all its numbers in digits, ``n/d`` fractions and points."""
    # Most numbers are plain ones already.
    return _let(c, lambda x: F.when(x.rlike(r"^[0-9]+([.][0-9]+)?$"), x).otherwise(_plain_number(x)))


def _plain_number(c: Column) -> Column:
    c = F.trim(F.regexp_replace(c, r"[\p{Z}\t\n\x0B\f\r]+", " "))
    for sign, text in FRACTIONS.items():
        c = F.replace(c, F.lit(sign), F.lit(f" {text}"))
    c = F.translate(c, "⁄–—−", "/---")
    c = F.regexp_replace(c, r"(\d*)#(\d+)\$(\d+)", "$1 $2/$3")
    c = F.regexp_replace(c, r"(?i)^[\s(~]*(?:(?:about|around|approximately|approx\.?|roughly|generous|scant|nearly|circa|ca\.?)[\s~]+)*[\s(~]*", "")
    spelled = c.rlike(rf"(?i)\b(dozen|half|quarter|{'|'.join(NUMBER_WORDS)})\b")
    c = F.when(spelled, _let(c, _digits)).otherwise(c)
    c = F.regexp_replace(c, r"(?i)(\d)\s+and\s+(\d+/\d+)", "$1 $2")
    # A comma before three digits groups thousands unless the number is below one.
    c = F.regexp_replace(c, r"\b([1-9]\d{0,2}),(\d{3})\b(?!,?\d)", "$1$2")
    c = F.regexp_replace(c, r"(\d),(\d)", "$1.$2")
    return F.trim(c)


def _digits(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?i)\ba\s+dozen\b", "12")
    for n, word in reversed([*enumerate(NUMBER_WORDS, 1)]):
        c = F.regexp_replace(c, rf"(?i)\b{word}\b", str(n))
    c = F.regexp_replace(c, r"(?i)(\d)\s+and\s+a\s+half\b", "$1 1/2")
    c = F.regexp_replace(c, r"(?i)(\d)\s+and\s+a\s+quarter\b", "$1 1/4")
    return F.regexp_replace(c, r"(?i)^\s*(?:a\s+)?half(?:\s+an?)?\b", "1/2")


def value_of(c: Column) -> Column:
    """The number of ``a``, ``a.b``, ``n/d`` or ``a n/d``; null for a zero denominator."""
    return _let(c, _value_of)


def _value_of(c: Column) -> Column:
    whole = F.regexp_extract(c, r"^(\d+)\s+\d+/\d+$", 1)
    top, bottom = F.regexp_extract(c, r"(\d+)/\d+$", 1), F.regexp_extract(c, r"\d+/(\d+)$", 1)
    ratio = F.try_divide(top.try_cast("double"), bottom.try_cast("double"))
    return F.when(c.contains("/"), ratio + F.when(whole == "", F.lit(0.0)).otherwise(whole.try_cast("double"))).otherwise(c.try_cast("double"))


def unit_key(c: Column) -> Column:
    """A unit spelling reduced to what tells it: letters and single spaces, in
    lower case unless it is one letter."""
    return _let(c, _unit_key)


def _unit_key(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?i)[\s)]*\b(?:measured|weight|each|or so)[\s).]*$", "")
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"[.()_]", " "), r"\s+", " "))
    return F.when(F.length(c) > 1, F.lower(c)).otherwise(c)


def _weighted(a: str, b: str) -> float:
    """Edit distance of spellings: vowels, plurals and doubled letters are cheap, first letters dear."""
    vowels = "aeiouy"

    def drop(s: str, i: int) -> float:
        if i and s[i] == s[i - 1]:
            return 0.4
        if i == len(s) - 1 and s[i] == "s":
            return 0.3
        return 1.5 if i == 0 else 0.7 if s[i] in vowels else 1.0

    def swap(x: str, y: str, first: bool) -> float:
        return 0.0 if x == y else 1.5 if first else 0.6 if x in vowels and y in vowels else 1.0

    two, one = None, [0.0]
    for j in range(len(b)):
        one.append(one[-1] + drop(b, j))
    for i in range(len(a)):
        row = [one[0] + drop(a, i)]
        for j in range(len(b)):
            v = min(row[-1] + drop(b, j), one[j + 1] + drop(a, i), one[j] + swap(a[i], b[j], i == 0 and j == 0))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                v = min(v, two[j - 1] + 0.6)
            row.append(v)
        two, one = one, row
    return one[-1]


@F.pandas_udf(T.DoubleType())
def _edit_cost(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([_weighted(x, y) for x, y in zip(a, b)], dtype="float64")


def resolve_units(spellings: DataFrame, units: DataFrame) -> DataFrame:
    """``key, unit, dimension, factor`` of ``key`` (distinct spellings, see ``unit_key``).

    ``units``: ``unit, dimension, factor_to_base``.  Names of at most three
    letters must be met exactly.  A spelling without a name close enough has
    no row.  Ties go to the alphabetically first unit.
    """
    spark = spellings.sparkSession
    names = [(n, u) for u, ns in NAMES.items() for n in ns]
    names += [(u.replace("_", " "), u) for u in NAMES]
    known = spark.createDataFrame(sorted(set(names)), "name string, base string")
    # Further units of the table are known by their own names.
    own = units.select(F.lower(F.replace("unit", F.lit("_"), F.lit(" "))).alias("name"), F.col("unit").alias("base"))
    own = own.where(~F.col("name").startswith("imperial "))
    known = known.unionByName(own).distinct()
    system = F.regexp_extract("key", rf"^({'|'.join((*IMPERIAL, *US))})\s+(.*)$", 1)
    bare = F.when(system == "", F.col("key")).otherwise(F.regexp_extract("key", rf"^(?:{'|'.join((*IMPERIAL, *US))})\s+(.*)$", 1))
    typed = spellings.where("key <> ''").select("key", bare.alias("bare"), system.isin(*IMPERIAL).alias("imperial"))
    padded = lambda c: F.concat(F.lit("^"), F.col(c), F.lit("$"))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substr(padded(c), i, F.lit(2))))
    index = known.select("name", "base", F.explode(grams("name")).alias("gram"))
    probes = typed.select("bare").distinct().select("bare", F.explode(grams("bare")).alias("gram"))
    exact = typed.select("bare").distinct().join(known, F.col("bare") == F.col("name")).select("bare", "base", F.lit(0.0).alias("cost"))
    met = probes.join(index, "gram").groupBy("bare", "name", "base").agg(F.count(F.lit(1)).alias("shared"))
    # Written before the Python distance, which would otherwise run once per shared gram.
    # Each edit spoils at most two of the pairs.
    met = met.where((F.length("bare") > 3) & (F.length("name") > 3) & (F.col("shared") >= F.length("bare") + 1 - 2 * F.ceil(F.length("bare") * MOST_EDITS / 0.3)))
    near = materialise(materialise(met).withColumn("cost", _edit_cost("bare", "name") / F.length("bare"))).where(F.col("cost") <= MOST_EDITS)
    best = exact.unionByName(near.select("bare", "base", "cost")).groupBy("bare").agg(F.min_by("base", F.struct("cost", "base")).alias("base"))
    full = typed.join(best, "bare")
    table = units.select(F.col("unit"), "dimension", F.col("factor_to_base").alias("factor"))
    imperial = F.concat(F.lit("imperial_"), F.col("base"))
    full = full.withColumn("unit", F.when(F.col("imperial"), imperial).otherwise(F.col("base")))
    direct = full.join(table, "unit").select("key", "unit", "dimension", "factor")
    # A unit that has no imperial form is the same in both systems.
    other = full.where("imperial").join(table, "unit", "left_anti").drop("unit").join(table, F.col("base") == F.col("unit"))
    return direct.unionByName(other.select("key", "unit", "dimension", "factor"))


def _parsed(rows: DataFrame) -> DataFrame:
    """``low, high, key`` from ``quantity, quantity_max, unit, text``."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    rows = with_values(rows, _q=plain_number(F.coalesce(some(F.col("quantity")), F.col("text"))), _m=plain_number(some(F.col("quantity_max"))))
    part = lambda c, i: F.regexp_extract(c, _AMOUNT, i)
    rows = with_values(rows, _a=value_of(part("_q", 1)), _u=F.coalesce(some(F.col("unit")), some(part("_q", 3))), _b=F.coalesce(some(part("_q", 2)), some(part("_m", 2)), some(part("_m", 1))))
    # The text is read only where neither the unit nor the quantity names a unit.
    unit = F.coalesce("_u", F.when(F.col("_u").isNull() & F.col("quantity").isNotNull(), some(part(plain_number(F.col("text")), 3))))
    rows = with_values(rows, _high=F.coalesce(value_of(F.col("_b")), F.col("_a")), key=unit_key(unit))
    return rows.withColumn("low", F.least("_a", "_high")).withColumn("high", F.greatest("_a", "_high")).drop("_q", "_m", "_a", "_b", "_u", "_high")


def common_amounts(amounts: DataFrame, composites: DataFrame, units: DataFrame) -> DataFrame:
    """``amount_id, recipe_id, line_no, source, dimension, low, high`` in base units.

    One row per amount that has a number and a known unit; a single value has
    ``low = high``.  A composite is the sum of its parts, or the first less
    the others if subtractive, and has a row only if all parts have one
    dimension.  Of an amount that was delivered again the latest row counts.
    Null in any field is an absent field; other columns are ignored.
    """
    keys = ["amount_id", "recipe_id", "line_no", "source"]
    when = F.coalesce("loaded_at", F.lit(0).cast("timestamp"))
    single = amounts.select(*keys, "quantity", "quantity_max", "unit", "text", when.alias("_at"))
    newest = F.max_by(F.struct(*keys[1:], "quantity", "quantity_max", "unit", "text"), F.struct("_at", F.xxhash64("quantity", "unit", "text")))
    single = single.groupBy("amount_id").agg(newest.alias("_r")).select("amount_id", "_r.*")
    single = single.withColumn("part", F.lit(0)).withColumn("parts", F.lit(1)).withColumn("sign", F.lit(1))
    many = composites.select(*keys, "amounts", "is_subtractive", when.alias("_at"))
    newest = F.max_by(F.struct(*keys[1:], "amounts", "is_subtractive"), F.struct("_at", F.xxhash64("amounts")))
    many = many.groupBy("amount_id").agg(newest.alias("_r")).select("amount_id", "_r.*")
    minus = (F.col("part") > 0) & F.coalesce("is_subtractive", F.lit(False))
    many = many.select(*keys, "is_subtractive", F.size("amounts").alias("parts"), F.posexplode("amounts").alias("part", "_p"))
    many = many.select(
        *keys, "_p.quantity", F.lit(None).cast("string").alias("quantity_max"), "_p.unit", "_p.text", "part", "parts",
        F.when(minus, -1).otherwise(1).alias("sign"),
    )
    read = materialise(_parsed(single.unionByName(many.select(*single.columns))))
    uses = read.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    aliases = materialise(resolve_units(uses.select("key"), units).join(uses, "key"))
    known = lookup(read, aliases.drop("unit"), "key", "uses", F.xxhash64("amount_id"), how="inner").where("low is not null")
    one = known.where("parts = 1 and part = 0 and sign = 1")
    one = one.select(*keys, "dimension", (F.col("low") * F.col("factor")).alias("low"), (F.col("high") * F.col("factor")).alias("high"))
    # A subtracted range is subtracted end by end.
    lows, highs = (F.sum(F.col("sign") * F.col(x) * F.col("factor")).alias(x) for x in ("low", "high"))
    several = known.where("parts > 1").groupBy(*keys).agg(
        F.min("dimension").alias("dimension"), F.max("dimension").alias("_d"), F.count(F.lit(1)).alias("_n"), F.max("parts").alias("_parts"), lows, highs
    )
    several = several.where("dimension = _d and _n = _parts").select(*keys, "dimension", "low", "high")
    return one.unionByName(several)


def equal_amounts(common: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """``id_a, id_b`` (id_a < id_b): amounts of one line and dimension whose
    ends differ by at most ``tolerance`` of the larger one.

    Values are put in logarithmic bins as wide as the tolerance, so equal
    amounts lie in the same or in neighbouring bins; a line with very many
    amounts is joined in blocks.  Amounts without recipe or line have no pairs.
    """
    width = -F.log(F.lit(1 - tolerance))
    bin_ = F.when(F.col("low") > 0, F.floor(F.log("low") / width)).otherwise(F.lit(-(10**9)))
    rows = common.where("recipe_id is not null and line_no is not null").select(
        F.col("amount_id").alias("sid"), "recipe_id", "line_no", "dimension", "low", "high", bin_.cast("bigint").alias("bin")
    )
    rows = rows.withColumn("at", F.explode(F.array(F.col("bin"), F.col("bin") + 1)))
    keyed = rows.withColumn("key", F.struct("recipe_id", "line_no", "dimension", "at")).select("key", "sid", "low", "high", "bin", "at")
    pairs = bucket_pairs(keyed, "key", block=1024).where("at_a = greatest(bin_a, bin_b)")
    close = lambda x: F.abs(F.col(f"{x}_a") - F.col(f"{x}_b")) <= F.lit(tolerance + 1e-9) * F.greatest(F.abs(f"{x}_a"), F.abs(f"{x}_b"))
    return pairs.where(close("low") & close("high")).select(F.col("sid_a").alias("id_a"), F.col("sid_b").alias("id_b"))


def unresolved_units(amounts: DataFrame, composites: DataFrame, units: DataFrame) -> DataFrame:
    """``spelling, n``: unit spellings that stand for no unit of the table, with their rows."""
    single = amounts.select("quantity", "quantity_max", "unit", "text")
    parts = composites.select(F.explode("amounts").alias("_p")).select("_p.quantity", F.lit(None).cast("string").alias("quantity_max"), "_p.unit", "_p.text")
    uses = materialise(_parsed(single.unionByName(parts)).where("key is not null and key <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    return uses.join(resolve_units(uses.select("key"), units), "key", "left_anti").select(F.col("key").alias("spelling"), "n")

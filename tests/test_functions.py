"""Normalisation and token functions against known pairs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.functions import normalise, rational, tokens
from quern.functions.porter import stem

# Own sentences, one or more for every step.
PAIRS = [
    ("&frac14; jar tahini (unsalted)", "#1$4 jar tahini (unsalted)"),
    ("4 5/8 parsnips", "4#5$8 parsnips"),
    ("nine limes", "nine limes"),
    ("walnut-size knob tamarind", "walnut-size knob tamarind"),
    ("7 plums – ripe or nearly so", "7 plums - ripe or nearly so"),
    ("6–9 dates", "6-9 dates"),
    ("dill—a little", "dill - a little"),
    ("5&frac18; cups oat milk", "5#1$8 cups oat milk"),
    ("6 and 1/3 tsp ground sumac", "6#1$3 tsp ground sumac"),
    ("⅝ cup millet", "#5$8 cup millet"),
    ("7⅖ cups stock", "7#2$5 cups stock"),
    ("⅛-⅜ teaspoon", "#1$8-#3$8 teaspoon"),
    ("65g hazelnuts", "65 g hazelnuts"),
    ("9-ounce trout, filleted", "9 ounce trout, filleted"),
    ("3kg4g fennel", "3 kg 4 g fennel"),
    ("3kg-4g fennel", "3 kg - 4 g fennel"),
    ("9 tbsp. miso", "9 tbsp miso"),
    ("6 lb. swede", "6 lb swede"),
    ("3 to 7 shallots, sliced", "3-7 shallots, sliced"),
    ("2- or 9- small quinces", "2-9- small quinces"),
    ("60 ml - 90.5 ml/2-3 oz cider", "60-90.5 ml/2-3 oz cider"),
    ("2 x 65 g/3 oz buns", "2x 65 g/3 oz buns"),
    ("⅓ - ⅔ cup kefir", "#1$3-#2$3 cup kefir"),
    ("6 oz - 9 ounce halibut ($12.75)", "6-9 oz halibut"),
    ("two-litre jug", "two litre jug"),
    ("salt &amp; vinegar", "salt & vinegar"),
    ("", ""),
    (None, None),
]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def test_normalise(spark):
    assert column(spark, [a for a, _ in PAIRS], normalise.normalise) == [b for _, b in PAIRS]


def test_normalise_without_python_agrees(spark):
    assert column(spark, [a for a, _ in PAIRS], lambda c: normalise.normalise(c, all_entities=False)) == [b for _, b in PAIRS]


def test_tokenise(spark):
    cases = {
        "9 dl plum juice": ["9", "dl", "plum", "juice"],
        "6 jars [80 g] capers": ["6", "jars", "[", "80", "g", "]", "capers"],
        "Toasted rye, to serve.": ["Toasted", "rye", ",", "to", "serve", "."],
        "5 leeks, rinsed*": ["5", "leeks", ",", "rinsed", "*"],
        "hazelnut and/or walnut oil": ["hazelnut", "and/or", "walnut", "oil"],
        "hard fruit, i.e. quince": ["hard", "fruit", ",", "i.e.", "quince"],
        "": [],
        "   ": [],
        None: None,
        "x" * 20000: ["x" * 20000],
    }
    assert column(spark, list(cases), tokens.tokenise) == list(cases.values())


@pytest.mark.parametrize(
    ("f", "yes", "no"),
    [
        (tokens.is_numeric, ["7", "4.125", "6-9", "#3$8", "2#1$4-3", "nine", "Twelve", "dozen", "6x", "2e4", "-7", "3_000", ".25"], ["00", "plum", "x", "7d", "0x1p3", "nan", "inf", "7-b", "-"]),
        (tokens.is_unit, ["jar", "Tin", "kg"], ["volt", "jars"]),
        (tokens.is_punctuation, ["/", "--", ","], ["plum", "b."]),
        (tokens.is_ambiguous_unit, ["leaves", "Rib", "wedge"], ["jar"]),
        (tokens.is_capitalised, ["Plum"], ["plum", "7"]),
    ],
)
def test_predicates(spark, f, yes, no):
    assert column(spark, yes, f) == [True] * len(yes)
    assert column(spark, no, f) == [False] * len(no)


def test_shapes_and_affixes(spark):
    assert column(spark, ["Rösti", "oven-dry", "Q7"], tokens.word_shape) == ["Xxxxx", "xxxx-xxx", "Xd"]
    assert column(spark, ["walnut", "rye", "!num"], lambda c: tokens.affix(c, 3, True)) == ["nut", None, None]
    assert column(spark, [0, 1, 3, 17, 100], tokens.length_bucket, "int") == [1, 1, 2, 16, 64]
    assert column(spark, [1, 2, 3, 4, 11, 112, 21], tokens.ordinal, "int") == ["1st", "2nd", "3rd", "4th", "11th", "112th", "21st"]


def test_units(spark):
    assert column(spark, ["6 teaspoon walnut oil", "5 jar (80 gram) capers", "leaf"], normalise.pluralise_units) == [
        "6 teaspoons walnut oil", "5 jars (80 grams) capers", "leaves",
    ]
    df = spark.createDataFrame([("oz", "ounce"), ("cups", "c"), ("kg", "g"), ("a", "b"), (None, "g")], "a string, b string")
    assert [r[0] for r in df.select(normalise.is_synonym(F.col("a"), F.col("b"))).collect()] == [True, True, False, False, False]


def test_rationals(spark):
    got = column(spark, ["2#3$8", "#6$9", "7", "0.125", "plum", None, "#5$0"], rational.from_token)
    assert [r and (int(r.num), int(r.den)) for r in got] == [(19, 8), (2, 3), (7, 1), (1, 8), None, None, None]


def test_stems():
    words = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop", "relational": "relat", "cherries": "cherri", "chopped": "chop", "purpose": "purpos", "electricity": "electr", "tomatoes": "tomato", "is": "is", "controlling": "control"}
    assert {w: stem(w) for w in words} == words


def test_sublist_index(spark):
    df = spark.createDataFrame([(["A", "red", "onion", "red"],), ([],), (["red"],)], "t array<string>")
    assert [r[0] for r in df.select(tokens.sublist_index(F.col("t"), ["red", "onion"])).collect()] == [1, -1, -1]
    assert [r[0] for r in df.select(tokens.sublist_index(F.col("t"), ["nio"], whole_words=False)).collect()] == [2, -1, -1]

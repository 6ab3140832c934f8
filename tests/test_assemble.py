"""Assembly of records from labelled tokens, unit names and conversion."""

from __future__ import annotations

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quern.functions import units
from quern.operators import assemble as asm

LETTER = {"Q": "QTY", "U": "UNIT", "C": "COMMENT", "P": "PUNC", "B": "B_NAME_TOK", "I": "I_NAME_TOK", "V": "NAME_VAR", "M": "NAME_MOD", "E": "NAME_SEP", "R": "PREP", "S": "PURPOSE", "Z": "SIZE"}


def parse(text, labels, tags=None, scores=None, **options):
    tokens = text.split()
    return asm.assemble(tokens, (tags or " ".join(["NN"] * len(tokens))).split(), [LETTER[x] for x in labels], scores or [0.0] * len(tokens), asm.Options(**options))


def brief(a):
    q = a["quantity"]
    flags = [f for f in asm._FLAGS if a[f]]
    return (str(Fraction(q["num"], q["den"])) if q else a["quantity_str"], a["unit"], a["text"], a["starting_index"], *flags)


def amounts(text, labels, **options):
    return [brief(a) for a in parse(text, labels, **options)["amount"]]


# Own sentences, one or more for every pattern.
@pytest.mark.parametrize(("text", "labels", "want"), [
    ("5 9 gram sachet of dry yeast", "QQUUCBI", [("5", "sachets", "5 sachets", 0), ("9", "gram", "9 grams", 1, "singular")]),
    ("6 tiny jar capers", "QUUB", [("6", "tiny jars", "6 tiny jars", 0)]),
    ("punnet of red currants", "UCBI", [("", "punnet", "punnet", 0)]),
    ("4 quinces , nearly two and three-quarter pound each", "QBPCQQQUC", [("4", "", "4", 0), ("11/4", "pound", "2 3/4 pounds", 4, "approximate", "singular")]),
    ("4 quinces , roughly three or four grams each", "QBPCQQQUC", [("4", "", "4", 0), ("3", "gram", "3-4 grams", 4, "approximate", "singular", "range")]),
    ("5 dozen figs each nearly 9 gram", "QQBCCQU", [("5 dozen", "", "5 dozen", 0), ("9", "gram", "9 grams", 5, "approximate", "singular")]),
    ("3x 65 g / 2 oz buns", "QQUCQUB", [("3", "", "3x", 0, "multiplier"), ("65", "gram", "65 g", 1), ("2", "ounce", "2 oz", 4)]),
    ("approx 90 g / 3 oz rye", "QUCQUB".replace("QU", "CQU", 1), [("90", "gram", "90 g", 1, "approximate"), ("3", "ounce", "3 oz", 4, "approximate")]),
    ("millet to make 5 cup", "BCCQU", [("5", "cup", "5 cups", 3, "prepared_ingredient")]),
    ("0.25-4 tsp sumac", "QUB", [("0.25-4", "teaspoon", "0.25-4 tsps", 0)]),
    ("4#3$8 cup rye", "QUB", [("35/8", "cup", "4 3/8 cups", 0)]),
    ("2#0$0 cup rye", "QUB", [("2#0$0", "cup", "2 0/0 cups", 0)]),
])
def test_amounts(text, labels, want):
    assert amounts(text, labels) == want


def test_range_keeps_singular_text():
    a = parse("4-7 tin lychees", "QUB")["amount"][0]
    assert (a["text"], a["unit"], a["range"], a["quantity_max"]) == ("4-7 tin", "tin", True, {"num": 7, "den": 1})


def test_composites():
    got = parse("700 g / 1 lb 9 oz trout", "QUCQUQUB")["amount"]
    assert [a["kind"] for a in got] == ["amount", "composite"]
    assert (got[1]["text"], got[1]["starting_index"], got[1]["subtractive"], len(got[1]["parts"])) == ("1 lb 9 oz", 3, False, 2)
    got = parse("6 cups plus 2 tsps millet", "QUCQUB")["amount"]
    assert (got[0]["text"], got[0]["join"]) == ("6 cups plus 2 tsps", " plus ")
    got = parse("6 cups less 2 tsps millet", "QUCQUB")["amount"]
    assert (got[0]["text"], got[0]["subtractive"]) == ("6 cups minus 2 tsps", True)


@pytest.mark.parametrize(("text", "labels", "tags", "want"), [
    ("5 9 gram sachet of dry yeast", "QQUUCBI", None, [("dry yeast", 5)]),
    ("9 tsp ghee or walnut oil", "QUBEBI", "CD JJ NN CC JJ NN", [("ghee", 2), ("walnut oil", 4)]),
    ("9 dl plum or quince juice", "QUVEVB", None, [("plum juice", 2), ("quince juice", 4)]),
    ("6 sprig of young dill or chervil", "QUCMBEB", None, [("young dill", 3), ("young chervil", 3)]),
    ("9 dl cold plum or quince juice", "QUMVEVB", None, [("cold plum juice", 2), ("cold quince juice", 2)]),
    ("#3$8 cup millet plus 2#1$4 teaspoon millet", "QUBCQUB", None, [("millet", 2)]),
    ("large , firm quinces", "BPBI", "JJ , JJ NNS", [("large, firm quinces", 0)]),
    (", , .", "PPP", None, []),
])
def test_names(text, labels, tags, want):
    assert [(n["text"], n["starting_index"]) for n in parse(text, labels, tags)["name"]] == want


def test_texts():
    r = parse("6 leeks , rinsed and cut into 9 mm ( #3$8 in ) rings", "QBPRRRRRRPRRPR")
    assert r["preparation"]["text"] == "rinsed and cut into 9 mm (3/8 in) rings" and r["preparation"]["starting_index"] == 3
    r = parse("9 tsp toasted millet", "QURB")
    assert r["amount"][0]["prepared_ingredient"]
    r = parse("5 9 gram sachet of dry yeast", "QQUUCBI")
    assert r["comment"] is None
    r = parse("5 9 gram sachet of dry yeast", "QQUUCBI", discard_isolated_stop_words=False)
    assert r["comment"]["text"] == "of"
    r = parse("rye ) and ( millet", "BPCPB", separate_names=False)
    assert [n["text"] for n in r["name"]] == ["rye millet"]
    assert parse("6 cup kefir", "QUB", string_units=True)["amount"][0]["unit"] == "cups"
    assert parse("6 cup kefir", "QUB", imperial_units=True)["amount"][0]["unit"] == "imperial_cup"


def test_scores_are_means():
    r = parse("5 9 gram sachet dry yeast", "QQUUBI", scores=[0.9, 0.8, 0.7, 0.5, 0.4, 0.2])
    assert [a["confidence"] for a in r["amount"]] == [0.7, 0.8] and r["name"][0]["confidence"] == 0.3


def test_record_column(spark):
    rows = [(1, ["1", "cup", "milk"], ["CD", "NN", "NN"], ["QTY", "UNIT", "B_NAME_TOK"], [1.0, 1.0, 1.0]), (2, None, None, None, None), (3, ["a"], [], ["QTY"], [1.0]), (4, [], [], [], [])]
    df = spark.createDataFrame(rows, "id int, t array<string>, p array<string>, l array<string>, s array<double>")
    got = {r.id: r.r for r in df.select("id", asm.record(F.col("t"), F.col("p"), F.col("l"), F.col("s")).alias("r")).collect()}
    assert got[1].name[0].text == "milk" and got[1].amount[0].unit == "cup" and int(got[1].amount[0].quantity.num) == 1
    assert got[3].name is None and got[4].name == [] and got[2].name is None


def test_units(spark):
    cases = {"": None, "g": "gram", "grams": "gram", "oz": "ounce", "fl oz": "fluid_ounce", "C": "cup", "Tb": "tablespoon", "pinch": None, "Bars": None, "a-b": None, "can": None, "Pt": "pint", "G": "gram"}
    assert {u: units.canonical_name(u) for u in cases} == cases
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.c for r in df.select("u", units.canonical(F.col("u")).alias("c")).collect()} == cases
    assert units.canonical_name("cup", True) == "imperial_cup" and units.canonical_name("oz", True) == "ounce"


def test_conversion(spark):
    df = spark.createDataFrame([(1.2, "kilogram", "gram", 1200.0), (500.0, "milliliter", "cup", 2.1133764), (2.0, "cup", "gram", 473.176473), (1.0, "inch", "gram", None), (1.0, None, "gram", None)], "v double, u string, t string, want double")
    for r in df.select("want", units.converted(F.col("v"), F.col("u"), F.col("t")).alias("got")).collect():
        assert r.got == (None if r.want is None else pytest.approx(r.want, rel=1e-6))
    df = spark.createDataFrame([([(1.0, "pound"), (2.0, "ounce")], False), ([(1.0, "pound"), (2.0, "ounce")], True), ([], False)], "p array<struct<value:double,unit:string>>, s boolean")
    got = [r[0] for r in df.select(units.combined(F.col("p"), F.lit("ounce"), F.col("s"))).collect()]
    assert got == [pytest.approx(18), pytest.approx(14), None]

"""End-to-end parse, spans over long tokens, experiments and the registry."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quern.functions import tokens as tk
from quern.functions.vocab import LABELS
from quern.operators import experiments, features, spans, structure
from quern.plans import core, parse


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(1, "2 cups fresh milk, chopped"), (2, "About 3 onions"), (3, None), (4, " "), (5, "milk")], "id int, sentence string")
    return parse.parse(df, "id", "sentence", *core._rule_weights(spark))


def test_parse(parsed):
    got = {r.sent_id: r for r in parsed.collect()}
    assert len(got) == 5 and got[3].name is None and got[4].amount is None
    a = got[1].amount[0]
    assert (int(a.quantity.num), a.unit, a.text) == (2, "cup", "2 cups") and got[1].preparation.text == "chopped"
    assert [n.text for n in got[5].name] == ["milk"] and got[2].name[0].text == "onions"


def test_foods_of_names(spark, parsed):
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(w, rng.normal(size=6).tolist()) for w in ("milk", "onion", "raw", "beef")], "token string, vec array<double>")
    foods = spark.createDataFrame([(7, "t", "Milk", "c", ["milk", "raw"]), (8, "t", "Beef", "c", ["beef"])], "fdc_id int, data_type string, description string, category string, tokens array<string>")
    got = {r.sent_id: r.foundation_foods for r in parse.with_foods(parsed, foods, vectors).collect()}
    assert got[5][0].fdc_id == 7 and got[5][0].name_index == 0 and got[5][0].url.endswith("/7/nutrients") and got[3] is None


def test_spans(spark):
    data = "about/COMMENT 2/QTY cup/UNIT (/PUNC 300/QTY g/UNIT )/PUNC each/COMMENT hot/NAME_MOD beef/NAME_VAR or/NAME_SEP vegetable/NAME_VAR stock/B_NAME_TOK"
    rows = [(1, i, *x.rsplit("/", 1)) for i, x in enumerate(data.split())] + [(2, 0, "bunch", "UNIT"), (2, 1, "each", "COMMENT")]
    df = spark.createDataFrame(rows, "sent_id int, idx int, token string, label string")
    got = {(r.sent_id, r.amount): (r.quantity, r.unit, r.approximate, r.singular) for r in spans.amount_groups(df).collect()}
    assert got == {(1, 1): ("2", "cup", True, False), (1, 2): ("300", "g", True, False), (2, 0): ("", "bunch", False, True)}
    names = [(r.kind, r.text) for r in spans.name_groups(df).orderBy("start").collect()]
    assert names == [("MOD", "hot"), ("VAR", "beef"), ("VAR", "vegetable"), ("TOK", "stock")]


def test_experiments(spark):
    words = [["2", "cup", "milk"], ["flour", "3", "tbsp"]]
    rows = [(i, k, f"word={w}") for i in range(20) for k, w in enumerate(words[i % 2])]
    attrs = spark.createDataFrame(rows + [(i, k, "bias=") for i, k, _ in rows], "sent_id int, idx int, attr string")
    truth = spark.createDataFrame([(i, ["B_NAME_TOK", "QTY", "UNIT"] if i % 2 else ["QTY", "UNIT", "B_NAME_TOK"], "s") for i in range(20)], "sent_id int, labels array<string>, source string")
    labels = ["QTY", "UNIT", "B_NAME_TOK"]
    grid = experiments.grid_search(attrs, truth, labels, {"c1": [0.0, 1e4], "rounds": [12], "bits": [8]}).collect()
    assert [r.c1 for r in grid] == ["0.0", "10000.0"] and grid[0].sentence_accuracy == 1.0 > grid[1].sentence_accuracy
    with pytest.raises(ValueError):
        experiments.grid_search(attrs, truth, labels, {"depth": [1]})
    search = {r.discarded: r.token_accuracy for r in experiments.feature_search(attrs, truth, labels, {"none": [], "words": ["word"]}, rounds=12, bits=8).collect()}
    assert search["none"] == 1.0 > search["words"]
    assert experiments.repeated(attrs, truth, labels, [1, 2], rounds=8, bits=8).count() == 2


def test_evaluation_trains_on_all_attributes(spark, tmp_path, monkeypatch):
    words = "2 cups red or green apples such as Gala , or 1 tsp salt".split()
    labels = "QTY UNIT B_NAME_TOK NAME_SEP B_NAME_TOK I_NAME_TOK COMMENT COMMENT COMMENT PUNC COMMENT COMMENT COMMENT COMMENT".split()
    data = [(i, "s", " ".join(words), words, labels) for i in range(10)]
    spark.createDataFrame(data, "id int, source string, sentence string, tokens array<string>, labels array<string>").write.parquet(f"{tmp_path}/training_rows.parquet")
    keys = {r.k for r in core._training(spark, str(tmp_path))[0].select(F.substring_index("attr", "=", 1).alias("k")).distinct().collect()}
    assert {"mip_start", "mip_end", "after_sentence_split", "example_phrase", "next_mip_end", "prev3_pos_ngram", "prev2_is_unit", "next2_word_shape", "next3_is_capitalised"} <= keys
    asked = []
    run = experiments.run
    monkeypatch.setattr(experiments, "run", lambda *args, **options: asked.append(options) or run(*args, rounds=1))
    assert core.crf_evaluate(spark, str(tmp_path)).count() and asked == [{}]


def test_ranges_and_floats(spark):
    df = spark.createDataFrame([("1-2",), ("0.5-1",), ("#1$2-#3$4",), ("3",), ("x",)], "t string")
    assert [tuple(r) for r in df.select(tk.is_range(F.col("t")), tk.is_float(F.col("t"))).collect()] == [(True, False), (False, False), (True, False), (False, True), (False, False)]


def test_rule_tags(spark):
    words = {"2": "CD", "of": "IN", "the": "DT", "or": "CC", "red": "JJ", "finely": "RB", "chopped": "VBN", "onions": "NNS", "milk": "NN", ",": ",", "c": "NN", "e.g.": "IN"}
    df = spark.createDataFrame([(w,) for w in words], "t string")
    assert {r.t: r.p for r in df.select("t", features.fixed_pos(F.col("t"), features.rule_pos(F.col("t"))).alias("p")).collect()} == words


def test_registry():
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(q) and all(callable(f) for f in q.values()) and "amounts_by_unit" in q


def test_rows_and_joins_tag_alike(spark, monkeypatch):
    """Both ways of tagging, with random weights for every attribute that occurs."""
    texts = ["2 cups (about 300 g) red or green peppers, plus more such as Tom or Ann", "1/2 tsp. sea salt", "200g/7oz plain flour or 1 tablespoon rice flour", "onion", "", None, "  ", "3 [large] eggs, beaten, plus 1 yolk"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, sentence string")
    tokens = structure.token_flags(features.context(features.token_table(df, "id", "sentence")))
    attrs = [r.attr for r in features.attributes(features.feature_maps(tokens)).select("attr").distinct().orderBy("attr").collect()]
    rng = np.random.default_rng(5)
    assert len(attrs) > 500 and {"bias=", "mip_start", "prev2_example_phrase", "next_after_sentence_split", "is_in_parens"} <= set(attrs)
    state = [(a, str(x), float(w)) for a in attrs for x, w in zip(rng.choice(LABELS, 2, replace=False), rng.normal(size=2))]
    trans = [(a, b, float(rng.normal())) for a in LABELS for b in LABELS]
    state, trans = spark.createDataFrame(state, "attr string, label string, w double"), spark.createDataFrame(trans, "src string, dst string, w double")
    fast = {r.sent_id: r for r in parse.labelled(df, "id", "sentence", state, trans).collect()}
    monkeypatch.setattr("quern.operators.tagger.MODEL_ROWS", 0)
    slow = {r.sent_id: r for r in parse.labelled(df, "id", "sentence", state, trans).collect()}
    assert set(fast) == set(slow) == set(range(len(texts)))
    for i, r in slow.items():
        assert (fast[i].labels, fast[i].pos or None, fast[i].sentence) == (r.labels, r.pos, r.sentence)
        assert r.scores is None and fast[i].scores is None or np.allclose(fast[i].scores, r.scores)
        assert r.marginals is None or np.allclose(fast[i].marginals, r.marginals)

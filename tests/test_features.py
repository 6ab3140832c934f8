"""Token tables, context, phrases and label patterns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.operators import features, structure

TAGGED = {
    1: ("2 tbsp chicken or beef stock", "CD NN NN CC NN NN", [[2, 3, 4, 5]], [], []),
    2: ("2 tbsp hot chicken or beef stock", "CD NN JJ NN CC NN NN", [[2, 3, 4, 5, 6]], [], []),
    3: ("2 tbsp olive , vegetable or sunflower oil", "CD NN JJ , JJ CC NN NN", [[2, 3, 4, 5, 6, 7]], [], []),
    4: ("2 tbsp olive , vegetable , or sunflower oil", "CD NN JJ , JJ , CC NN NN", [[2, 3, 4, 5, 6, 7, 8]], [], []),
    5: ("2 tbsp salt and black pepper", "CD NN NN CC JJ NN", [], [], []),
    6: ("1 tbsp fresh sage or 1 tsp dried sage", "CD NN JJ NN CC CD NN JJ NN", [], [4], []),
    7: ("1 kg potatoes , such as King Edward , peeled", "CD NN NNS , JJ IN NNP NNP , VBN", [], [], [[4, 5, 6, 7]]),
}


def test_phrases(spark):
    rows = [(i, k, w, w, p) for i, (s, t, *_) in TAGGED.items() for k, (w, p) in enumerate(zip(s.split(), t.split()))]
    df = spark.createDataFrame(rows, "sent_id int, idx int, text string, feat_text string, pos string")
    got = {r.sent_id: (r.mip, r.splits, r.examples) for r in structure.phrases(df).collect()}
    # A leading unit is no part of the phrase.
    assert got == {i: tuple(x[2:]) for i, x in TAGGED.items()}
    flags = {(r.sent_id, r.idx): r for r in structure.token_flags(df).collect()}
    assert flags[1, 2].mip_start and flags[1, 5].mip_end and not flags[1, 3].mip_start
    assert flags[6, 8].after_sentence_split and not flags[6, 3].after_sentence_split
    assert flags[7, 7].example_phrase and not flags[7, 8].example_phrase


@pytest.mark.parametrize(("labels", "pattern", "ignore", "want"), [
    ("QTY UNIT QTY UNIT UNIT", "QTY UNIT", False, [[0, 1], [2, 3]]),
    ("QTY PUNC UNIT COMMENT QTY UNIT", "QTY UNIT", True, [[0, 2], [4, 5]]),
    ("QTY PUNC UNIT", "QTY UNIT", False, []),
    ("QTY QTY UNIT UNIT", "QTY QTY UNIT UNIT", True, [[0, 1, 2, 3]]),
    ("", "QTY", False, []),
])
def test_label_matches(spark, labels, pattern, ignore, want):
    df = spark.createDataFrame([(labels.split(),)], "l array<string>")
    assert df.select(structure.label_matches(F.col("l"), pattern.split(), ignore)).first()[0] == want


def test_token_table_and_context(spark):
    df = spark.createDataFrame([(1, "2 cups (500ml) milk, plus more"), (2, None), (3, " ")], "id int, sentence string")
    rows = features.context(features.token_table(df, "id", "sentence")).orderBy("idx").collect()
    assert [r.text for r in rows] == ["2", "cup", "(", "500", "ml", ")", "milk", ",", "plus", "more"]
    assert [r.feat_text for r in rows][:4] == ["!num", "cup", "(", "!num"]
    assert [r.in_parens for r in rows] == [False, False, True, True, True, True, False, False, False, False]
    assert [r.after_comma for r in rows][-3:] == [False, True, True] and [r.after_plus for r in rows][-2:] == [False, True]
    assert rows[0].pos == "CD" and rows[1].is_unit and rows[7].is_punc


def test_feature_maps(spark):
    df = spark.createDataFrame([(1, "1 cup peeled carrots")], "id int, sentence string")
    t = structure.token_flags(features.context(features.token_table(df, "id", "sentence")))
    maps = {r.idx: r.features for r in features.feature_maps(t).collect()}
    f = maps[3]
    assert f["stem"] == "carrot" and f["token"] == "carrots" and f["prefix_5"] == "carro" and f["prev_stem"] == "peel"
    assert f["prev2_pos_ngram"] == "NN+VBN+NNS" and f["prev3_stem"] == "!num" and "next_stem" not in f
    assert f["mip_start"] == "false" and f["sentence_length"] == "4" and f["bias"] == ""
    assert "token" not in maps[0] and "prefix_3" not in maps[0]
    kept = features.select_features(features.feature_maps(t), ["stem"]).where("idx = 3").first().features
    assert "stem" not in kept and "token" in kept
    attrs = {r.attr for r in features.attributes(features.feature_maps(t)).where("idx = 1").collect()}
    assert {"stem=cup", "is_unit", "bias="} <= attrs and "is_punc" not in attrs


def test_tag_table_and_islands(spark):
    df = spark.createDataFrame([(1, "salt salt pepper")], "id int, sentence string")
    tags = spark.createDataFrame([("salt", "XX"), ("salt", "YY")], "token string, tag string")
    got = features.token_table(df, "id", "sentence", tags)
    assert [r.pos for r in got.orderBy("idx").collect()] == ["XX", "XX", "NN"]
    rows = spark.createDataFrame([(1, i) for i in (0, 1, 3, 4, 7)], "s int, idx int")
    by = {r.idx: r.island for r in features.islands(rows, ["s"]).collect()}
    assert by[0] == by[1] != by[3] == by[4] != by[7]

"""CRF, evaluation, quality, catalogue, sources, streaming and runtime idioms."""

from __future__ import annotations

import gzip
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.vocab import LABELS
from quern.operators import catalogue, clusters, crf, evaluation, quality
from quern.runtime import bucket_pairs, lookup, materialise
from quern.sources import io
from quern.streaming import live

# -- runtime -------------------------------------------------------------------


def test_lookup_with_hot_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr("quern.runtime.HOT_LEAST", 10)
    rows = [(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(1000, None), (1001, "none")]
    big = spark.createDataFrame(rows, "id int, k string")
    table = big.where("k is not null and k <> 'none'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("v"))
    got = {r.id: r.v for r in lookup(big, table, "k", "n", F.xxhash64("id")).collect()}
    want = {r["k"]: r["v"] for r in table.collect()}
    assert len(got) == len(rows) and got == {i: want.get(k) for i, k in rows}
    assert lookup(big, table, "k", "n", F.xxhash64("id"), how="inner").count() == 300
    assert lookup(big.limit(0), table.limit(0), "k", "n", F.xxhash64("id")).count() == 0


@pytest.mark.parametrize("block", [1, 2, 5, 100])
def test_bucket_pairs_finds_each_pair_once(spark, block):
    rows = [(i, "a" if i < 9 else f"b{i // 2}") for i in range(14)] + [(50, None), (51, None)]
    got = bucket_pairs(spark.createDataFrame(rows, "sid int, key string"), "key", block).collect()
    want = {(i, j) for i, a in rows for j, b in rows if i < j and a == b and a}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_materialise_keeps_rows(spark):
    assert materialise(spark.range(5)).count() == 5 and materialise(spark.range(0)).count() == 0


# -- CRF -----------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_and_marginals_match_enumeration(seed):
    rng = np.random.default_rng(seed)
    n, k = rng.integers(1, 5), 3
    e, t = rng.normal(size=(n, k)), rng.normal(size=(k, k))
    paths = list(product(range(k), repeat=n))
    score = np.array([sum(e[i, y] for i, y in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:])) for p in paths])
    assert tuple(crf.viterbi(e, t)) == paths[int(score.argmax())]
    p = np.exp(score - np.logaddexp.reduce(score))
    want = np.array([[sum(w for w, path in zip(p, paths) if path[i] == y) for y in range(k)] for i in range(n)])
    assert np.allclose(crf.marginals(e, t), want) and np.allclose(crf.marginals(e, t).sum(1), 1)


def test_train_and_tag(spark):
    data = [(i, [["w=2"], ["w=cup"], ["w=milk" if i % 2 else "w=flour"]], ["QTY", "UNIT", "B_NAME_TOK"]) for i in range(12)]
    data += [(100, [["w=2"]], ["QTY", "UNIT"]), (101, [["w=2"]], ["OTHER"]), (102, [], [])]
    df = spark.createDataFrame(data, "sent_id int, attrs array<array<string>>, labels array<string>")
    state_w, trans_w = crf.train(df, LABELS, rounds=15, bits=10)
    attrs = spark.createDataFrame([(1, 0, "w=2"), (1, 1, "w=cup"), (1, 2, "w=flour"), (2, 0, "w=unseen")], "sent_id int, idx int, attr string")
    got = {r.sent_id: r for r in crf.tag(attrs, state_w, trans_w, LABELS).collect()}
    assert got[1].labels == ["QTY", "UNIT", "B_NAME_TOK"] and all(s > 0.4 for s in got[1].scores)
    assert len(got[2].labels) == 1 and sum(got[2].marginals[0]) == pytest.approx(1)


def test_guess_names(spark):
    i = {x: LABELS.index(x) for x in LABELS}

    def m(**p):
        row = [0.0] * len(LABELS)
        for k, v in p.items():
            row[i[k]] = v
        return row

    ms = [m(QTY=0.9), m(COMMENT=0.6, B_NAME_TOK=0.3), m(PREP=0.9), m(COMMENT=0.5, B_NAME_TOK=0.4), m(COMMENT=0.5, I_NAME_TOK=0.45)]
    rows = [(1, ["QTY", "COMMENT", "PREP", "COMMENT", "COMMENT"], [0.9] * 5, ms), (2, ["B_NAME_TOK"], [0.9], [m(B_NAME_TOK=0.9)]), (3, ["QTY"], [0.9], [m(QTY=0.9)])]
    df = spark.createDataFrame(rows, "sent_id int, labels array<string>, scores array<double>, marginals array<array<double>>")
    got = {r.sent_id: r for r in crf.guess_names(df, LABELS).collect()}
    assert got[1].labels == ["QTY", "COMMENT", "PREP", "B_NAME_TOK", "I_NAME_TOK"] and got[1].scores[3:] == [0.4, 0.45]
    assert got[2].labels == ["B_NAME_TOK"] and got[3].labels == ["QTY"]
    short = {r.sent_id: r for r in crf.guess_names(df, LABELS, longest=False).collect()}
    assert short[1].labels == ["QTY", "B_NAME_TOK", "PREP", "COMMENT", "COMMENT"]


def test_emissions_sum_weights(spark):
    attrs = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 1, "z")], "sent_id int, idx int, attr string")
    w = spark.createDataFrame([("a", "QTY", 1.0), ("b", "QTY", 2.0), ("b", "UNIT", 5.0)], "attr string, label string, w double")
    assert {(r.idx, r.label): r.score for r in crf.emissions(attrs, w).collect()} == {(0, "QTY"): 3.0, (0, "UNIT"): 5.0}


# -- evaluation and quality ----------------------------------------------------


def test_metrics(spark):
    rows = [(1, 0, "A", "A"), (1, 1, "B", "A"), (2, 0, "B", "B"), (2, 1, "A", "A"), (3, 0, "C", "B")]
    df = spark.createDataFrame(rows, "sent_id int, idx int, truth string, pred string")
    m = {r.label: r for r in evaluation.label_metrics(df).collect()}
    assert (m["A"].precision, m["A"].recall, m["A"].support) == (pytest.approx(2 / 3), 1.0, 2)
    assert (m["C"].precision, m["C"].recall, m["C"].f1) == (0.0, 0.0, 0.0)
    assert m["macro avg"].recall == pytest.approx(0.5) and m["weighted avg"].recall == pytest.approx(0.6)
    a = evaluation.accuracy(df).first()
    assert (a.tokens, a.token_accuracy, a.sentences, a.sentence_accuracy) == (5, 0.6, 3, pytest.approx(1 / 3))
    assert {r.truth: (r.A, r.B) for r in evaluation.confusion(df, ["A", "B"]).collect()} == {"A": (2, 0), "B": (1, 1), "C": (0, 1)}
    assert {r.sent_id: r.n_wrong for r in evaluation.mismatches(df).collect()} == {1: 1, 3: 1}


def test_stratified_split_is_exact(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else None) for i in range(1000)], "id int, source string")
    got = evaluation.stratified_split(df, "id", "source")
    assert got.count() == 1000
    assert {r.source: r.n for r in got.where("is_test").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()} == {"a": 180, None: 20}


def test_quality(spark):
    rows = [
        (1, "s", "x", ["a", "b"], ["B_NAME_TOK", "I_NAME_TOK"]), (2, "s", "x", ["a", "b"], ["B_NAME_TOK", "UNIT"]), (3, "t", "y", ["a"], ["I_NAME_TOK", "QTY"]),
        (4, None, None, None, None), (5, "t", "z", ["a", "c", "b"], ["B_NAME_TOK", "COMMENT", "I_NAME_TOK"]), (6, "t", "w", ["Ab", "B"], ["OTHER", "QTY"]),
    ]
    df = spark.createDataFrame(rows, "id int, source string, sentence string, tokens array<string>, labels array<string>")
    assert [r.id for r in quality.length_mismatches(df).collect()] == [3]
    assert [(r.sentence, r.n_rows, r.n_labellings) for r in quality.conflicting_sentences(df).collect()] == [("x", 2, 2)]
    assert [(r.id, r.idx) for r in quality.broken_bio(df).collect()] == [(3, 0)]
    assert sorted(r.id for r in quality.without_other(df).collect()) == [1, 2, 5]
    assert sorted(r.id for r in quality.search(df, ["a", "b"]).collect()) == [1, 2, 6][:2]
    assert [r.id for r in quality.search(df, ["a", "b"], ["B_NAME_TOK", "I_NAME_TOK"]).collect()] == [1]
    assert sorted(r.id for r in quality.search(df, ["b"], whole_words=False, any_case=False).collect()) == [1, 2, 5, 6]
    assert sorted(r.id for r in quality.by_ids(df, "1, 3..4").collect()) == [1, 3, 4]
    for bad in ("x", "1..", "1..x"):
        with pytest.raises(ValueError):
            quality.by_ids(df, bad)
    assert [r.id for r in quality.page(df, 2, 2).collect()] == [3, 4]
    assert sorted(r.source for r in quality.sources(df).collect()) == ["s", "t"]
    up = quality.upsert(df.select("id", "source"), spark.createDataFrame([(1, "new"), (9, "new")], "id int, source string"), spark.createDataFrame([(2,)], "id int"))
    assert {r.id: r.source for r in up.collect()}[1] == "new" and {r.id for r in up.collect()} == {1, 3, 4, 5, 6, 9}


# -- catalogue -----------------------------------------------------------------


def test_preferred_entries(spark):
    rows = [(1, "survey_fndds_food", "x", "2020-01-01"), (2, "foundation_food", "x", "2019-01-01"), (3, "foundation_food", "x", "2021-01-01"), (4, "new_kind", "y", "2020-01-01"), (5, "new_kind", "y", "2020-01-01")]
    df = spark.createDataFrame(rows, "fdc_id int, data_type string, description string, d string").withColumn("publication_date", F.to_date("d")).drop("d")
    assert sorted(r.fdc_id for r in catalogue.preferred_entries(df).collect()) == [3, 4]


def test_spelling(spark):
    cases = [(["coriand"], ["cilantro"]), (["plain", "flour"], ["all", "purpos", "flour"]), (["lemongrass", "Chilli"], ["lemon", "grass", "chili"]), (["singl", "cream", "cream"], ["light", "cream", "cream"]), ([], [])]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, t array<string>")
    assert [r[0] for r in df.orderBy("i").select(catalogue.normalise_spelling(F.col("t"))).collect()] == [b for _, b in cases]


def test_match(spark):
    rng = np.random.default_rng(0)
    words = ["onion", "red", "raw", "milk", "skim", "bread", "beef"]
    vec = {w: rng.normal(size=8).tolist() for w in words}
    vectors = spark.createDataFrame([(w, v) for w, v in vec.items()], "token string, vec array<double>")
    foods = spark.createDataFrame([(1, ["onion", "red", "raw"]), (2, ["milk", "skim"]), (3, ["bread"])], "fdc_id int, tokens array<string>")
    names = spark.createDataFrame([(10, ["onion", "red"]), (11, ["bread"]), (12, ["zzz"]), (13, [])], "qid int, tokens array<string>")
    fixed = spark.createDataFrame([(["bread"], 7)], "tokens array<string>, fdc_id int")
    got = {r.qid: (r.fdc_id, r.confidence) for r in catalogue.match(names, foods, vectors, fixed).collect()}
    assert got[10] == (1, 1.0) and got[11] == (7, 1.0) and 12 not in got and 13 not in got


def test_embedding_matches_numpy(spark):
    rng = np.random.default_rng(1)
    vec = {w: rng.normal(size=4) for w in "abc"}
    docs = {1: ["a", "b"], 2: ["c"], 3: ["z"], 4: ["a"]}
    vectors = spark.createDataFrame([(w, v.tolist()) for w, v in vec.items()], "token string, vec array<double>")
    df = spark.createDataFrame([(i, t) for i, t in docs.items()], "id int, tokens array<string>")
    p = catalogue.token_probability(df)
    f = catalogue.weight_factor(df, p)
    a, prob = f[0], {r.token: r.p for r in p.collect()}
    got = {r.id: r.vec for r in catalogue.embed(df, vectors, p, f).collect()}
    m = np.array([vec["a"], vec["b"]])
    w = np.array([[a / (0.5 * a + prob[t])] for t in "ab"])
    assert np.allclose(got[1], (m / np.linalg.norm(m, axis=0) * w).mean(0)) and np.allclose(got[3], [a] * 4)
    assert np.allclose(np.abs(got[2]), a / (0.5 * a + prob["c"]))


def test_clusters(spark):
    df = spark.createDataFrame([(i, ["red", "onion"] if i % 2 else ["skim", "milk"]) for i in range(20)] + [(99, None), (98, [])], "id int, tokens array<string>")
    got = clusters.sentence_clusters(df, 2).collect()
    assert len(got) == 20 and len({r.cluster for r in got}) == 2 and clusters.members(clusters.sentence_clusters(df, 2), got[0].cluster).count() == 10


# -- sources and streams -------------------------------------------------------


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "s", "x", '["a","b"]', '["QTY","B_NAME_TOK"]')], "id int, source string, sentence string, tokens string, labels string")
    df.write.parquet(str(tmp_path / "t"))
    got = io.labelled_sentences(spark, str(tmp_path / "t"), ["s"])
    assert got.first().tokens == ["a", "b"] and io.labelled_sentences(spark, str(tmp_path / "t"), ["none"]).count() == 0
    assert io.export_rows(got).first().name == "b"
    lines = spark.createDataFrame([(1, "x"), (2, "x")], "line int, sentence string")
    assert {r.line: r.id for r in io.matched_export(df, lines).collect()} == {1: 1, 2: None}
    foods = spark.createDataFrame([(1, "k", 'Plum, "dried"', "c")], "fdc_id int, data_type string, description string, category string")
    io.write_food_catalogue(foods, str(tmp_path / "f"))
    assert io.food_catalogue(spark, str(tmp_path / "f")).count() == 1
    with gzip.open(tmp_path / "v.txt.gz", "wt") as f:
        f.write("2 3\nonion 1 2 3\nbad 1 x 3\nmilk 0.5 0 -1\n")
    assert {r.token: r.vec for r in io.vectors(spark, str(tmp_path / "v.txt.gz")).collect()} == {"onion": [1, 2, 3], "milk": [0.5, 0, -1]}
    io.write_csv(foods, str(tmp_path / "tsv"), "\t")
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "tsv")).count() == 1


def test_streams(spark, tmp_path):
    rows = [(i, f"{i} cups milk", f"2024-01-0{1 + i % 3} 10:00:00") for i in range(9)]
    df = spark.createDataFrame(rows, "id int, sentence string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in.parquet"))
    stream = spark.readStream.schema(df.schema).parquet(live.files(str(tmp_path), "in"))
    got = {r.id: r.tokens for r in live.run_once(live.tokenised(stream).select("id", "tokens")).collect()}
    assert got == {r.id: r.tokens for r in live.tokenised(df).collect()} and got[3] == ["3", "cups", "milk"]
    counts = live.run_once(live.counts(spark.readStream.schema(df.schema).parquet(live.files(str(tmp_path), "in")), "ts", "sentence", "1 day"))
    assert counts.columns == ["start", "sentence", "n"] and counts.count() >= 6

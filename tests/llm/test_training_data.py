"""Training-data operators against brute force on small tables."""

from __future__ import annotations

import random
import re
import unicodedata
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import canon, copies, cross, cutoff, garbled, leaks, lookalike, mixing, near

ROW = "id long, sentence string, source string, data_split string, text string, sid long, n long, key string"


def rows(spark, sentences, splits=None, sources=None):
    """A table with columns whose names the operators use inside."""
    data = [(i, s, (sources or {}).get(i, "src"), (splits or {}).get(i, "train"), "clash", -1, -1, "clash") for i, s in enumerate(sentences, 1)]
    return spark.createDataFrame(data, ROW)


def pairs(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def piece_key(s):
    out = []
    for p in re.split("[,;]", s.lower()):
        q = "".join(c for c in p if unicodedata.category(c)[0] not in "ZPS" and c not in "\t\n\x0b\f\r\x85")
        if q:
            out.append(q)
    return tuple(sorted(out))


def words(s):
    return frozenset(re.findall(r"[^\W_]+", s.lower()))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


SENTENCES = [
    "2 cups red onion, chopped", "2 CUPS red onion; chopped", "chopped,2 cups red onion!", "2 cups redonion, chopped", "2 cups red onion, chopped, chopped",
    None, "", "   ", " ", "...", "??!", "2 cups red on​ion, chopped", "2 cups rеd onion, chopped", "２ cups red onion, chopped", "2 cups red onion, sliced thinly",
    "x" * 30000, "x" * 30000 + "!", "½ cup crème fraîche", "1/2 cup crème fraîche", "½ cup creme fraiche", "½ cup crème fraîche", "2 cups  red onion, chopped", "2 cups red onion, chopped",
]


# -- 1 copies --------------------------------------------------------------------


def test_copies_match_brute_force(spark):
    df = rows(spark, SENTENCES)
    sets: dict = {}
    for i, s in enumerate(SENTENCES, 1):
        if s is not None and re.search(r"[^\s ]", s):
            sets.setdefault(piece_key(s), []).append(i)
    want = {(v[0], x) for v in sets.values() for x in v[1:]}
    assert pairs(copies.found(df)) == want and (10, 11) in want
    got = {r.id: (r.first_id, r.n_copies) for r in copies.copy_sets(df).collect()}
    assert got == {x: (v[0], len(v)) for v in sets.values() for x in v}
    recs = {r.first_id: r for r in copies.collapse(df).collect()}
    assert set(recs) == {v[0] for v in sets.values()} and recs[1].sentence == SENTENCES[0] and recs[1].n_copies == len(sets[piece_key(SENTENCES[0])])


def test_copies_of_one_hot_sentence_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr("quern.runtime.HOT_LEAST", 5)
    df = rows(spark, ["a, b"] * 30 + ["B; a"] * 10 + ["c"])
    assert len(pairs(copies.found(df))) == 39
    twice = df.unionByName(df)
    assert len(pairs(copies.found(twice))) == 39 and copies.collapse(twice).where("first_id = 1").first().n_copies == 80


@pytest.mark.parametrize("f", [copies.found, copies.copy_sets, copies.collapse, near.found, near.groups, lookalike.found, lookalike.consistent, garbled.found, garbled.repaired, cross.found, cross.report, cross.edit_pairs])
def test_empty_and_null_tables(spark, f):
    assert f(rows(spark, [])).count() == 0
    got = f(rows(spark, [None, "", " "], sources={1: None, 2: None, 3: None}))
    assert got.count() == (3 if f is lookalike.consistent else 0)


# -- 2 near-duplicates -------------------------------------------------------------


@pytest.mark.parametrize("t", [0.3, 0.6, 0.8, 0.95])
def test_signatures_meet_for_all_similar_sets(t):
    """PartEnum alone: any two similar sets share a signature, whichever words are frequent."""
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(400):
        base = rng.integers(-(2**60), 2**60, rng.integers(1, 60))
        a, kept = np.unique(base), np.unique(base)[rng.random(len(np.unique(base))) > rng.random() / 2]
        b = np.unique(np.concatenate([kept, rng.integers(-(2**60), 2**60, rng.integers(0, 4))]))
        frequent = rng.permutation(base)[: rng.integers(0, len(base) + 1)]
        x, y = near.signatures([a, b], t, frequent)
        if len(b) and jaccard(set(a), set(b)) >= t:
            met += 1
            assert set(x) & set(y)
    assert met > 20


@pytest.mark.parametrize("frequent", [2, 20, 2000])
def test_near_matches_brute_force(spark, frequent):
    rng = random.Random(7)
    vocab = ["cup", "cups", "of", "red", "onion", "from", "brand", "chopped", "2", "3", "with", "style"]
    base = [[*rng.sample(vocab, rng.randint(1, 7)), *(f"name{rng.randint(0, 12)}" for _ in range(rng.randint(0, 3)))] for _ in range(40)]
    sents = [" ".join(b) for b in base]
    for b in base:
        for _ in range(3):
            e = [*b]
            for _ in range(rng.randint(0, 2)):
                e[rng.randrange(len(e))] = rng.choice(vocab)
            rng.shuffle(e)
            sents.append(" ".join(e))
    sents += ["Red Onion, cup", "cup; red onion", "red оnion cup", None, "", "...", "one two three " * 500]
    df = rows(spark, sents)
    form = {r.id: r.form for r in lookalike.consistent(df).collect()}
    real = [(i, s) for i, s in enumerate(sents, 1) if s and s.strip()]
    want = {(i, j) for (i, a), (j, b) in combinations(real, 2) if jaccard(words(a), words(b)) >= 0.6 and piece_key(a) != piece_key(b) and form[i] != form[j]}
    assert pairs(near.found(df, frequent=frequent)) == want and len(want) > 50
    classes: dict = {}
    for i, s in real:
        classes.setdefault(words(s), i)
    links = {c: sum(1 for o in classes if o != c and jaccard(c, o) >= 0.6) for c in classes}
    got = {r.id: (r.class_id, r.n_links) for r in near.groups(df, frequent=frequent).collect()}
    assert got == {i: (classes[words(s)], links[words(s)]) for i, s in real}


# -- 3 look-alikes -----------------------------------------------------------------


def test_lookalike_pairs(spark):
    s = ["one cup onion", "оnе cup onion", "ｏｎｅ cup onion", "one cup onion", "one cup oni­on", "one  cup onion", "one\tcup onion", "One cup onion", "½ cup", "1/2 cup", "грибы", "one cup onion, грибы", "one сuр onion, грибы", "ﬁg", "fig", "café", "café", "cafe", "1‑2", "1-2", "1–2", "𝐨𝐧𝐞 cup onion"]
    got = pairs(lookalike.found(rows(spark, s)))
    same = [[1, 2, 3, 4, 5, 22], [12, 13], [14, 15], [16, 17], [19, 20]]
    assert got == {p for g in same for p in combinations(g, 2)}


def test_repair_needs_the_vocabulary(spark):
    df = rows(spark, ["plain onion here", "Κοstas says", "оnion", "наtо base"])
    form = {r.id: r.form for r in lookalike.consistent(df).collect()}
    # No corpus word "Kostas" or "nato": the mixed tokens stay; "onion" is one.
    assert form == {1: "plain onion here", 2: "Κοstas says", 3: "оnion", 4: "наtо base"} or form[3] == "onion"
    two = {r.id: r.form for r in lookalike.consistent(rows(spark, ["crисp onion bread", "crisp onion bread", "a оnion"])).collect()}
    assert two[3] == "a onion" and two[1] == "crисp onion bread"


def test_strict_forms_change_mixed_tokens_with_a_corpus_word_only(spark):
    s = ["one cup onion", "оne cup onion", "one сuр onion", "fresh тор salt", "fresh тоp salt", "crisp bread", "crisр Ьread"]
    form = {r.id: r.form for r in lookalike.consistent(rows(spark, s), strict=True).collect()}
    # A wholly foreign token stays, and so does a mixed one whose result is no corpus word; a token goes to its dominant script.
    assert form[2] == form[3] == "one cup onion" and form[4] == form[5] == s[3] and form[7] == "crisp Ьread"


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_fold_is_stable(text):
    once = lookalike.fold(text)
    assert lookalike.fold(once) == once


# -- 4 garbled text ----------------------------------------------------------------

SOUND = ["2 cups crème fraîche", "sautéed leeks", "jalapeño, piñon nuts", "½ cup açaí pulp", "1–2 cups", "грибы, ελιά", "São Velmo, MAÇÃ, «extra», 180 °C, £3, naïve Âme", "2¼ cups"] * 3


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1251", "cp437", "mac_roman"])
def test_wrong_decodings_are_restored(spark, codec):
    text = "2¼ cups crème fraîche, sautéed jalapeño"
    bad = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in text.encode())
    got = {r.id: r for r in garbled.repaired(rows(spark, [*SOUND, bad], sources={1: "côte", 2: "côte", 3: bad})).collect() if r.field_name == "sentence"}
    assert set(got) == {len(SOUND) + 1} and got[len(SOUND) + 1].restored == text and got[len(SOUND) + 1].complete


def test_lost_bytes_double_decoding_and_look_alikes(spark):
    twice = "sautéed leeks".encode().decode("cp1252").encode().decode("cp1252")
    lost = "saut�ed leeks, �Name�"
    sents = [*SOUND, twice, lost, "Ріѕtа Маіn Вј ѕее Кі", "fraîche crème"]
    got = {r.id: r for r in garbled.repaired(rows(spark, sents)).collect()}
    n = len(SOUND)
    assert got[n + 1].restored == "sautéed leeks" and got[n + 2].restored == "sautéed leeks, �Name�" and not got[n + 2].complete
    assert n + 4 not in got and n + 5 not in got
    assert pairs(garbled.found(rows(spark, ["x"], sources={1: "cÃ´te"}))) == {(1, "source")}


def test_lost_bytes_agree_with_all_kept_characters(spark):
    want = {
        "г�иль": "гриль", "ск�т": "скот", "��иль": "гриль", "ελ��": "ελιά", "Ã�tÃ©": "Été", "sautÃ�ed": "sautéed", "sautÃƒ�©ed": "sautéed", "Рі�ЂРёР»СЊ": "гриль",
        "РіСЂРё�Р»СЊ": None, "«cr�me»": "«crème»", "�": None, "жжж�": None, "cr��me": "crème", "côt�": "côté", "a�a�": "açaí",
    }
    sound = [*SOUND, *["гриль", "скот", "Été", "côté", "crâme"], *["грибы"] * 5, *["crème"] * 3]
    got = {r.value: r for r in garbled.repaired(rows(spark, [*sound, *want], sources={1: "côte"})).collect()}
    assert {bad: got[bad].restored for bad in want} == want
    assert all(got[bad].complete == (new is not None) for bad, new in want.items())


def test_best_path_over_words():
    arcs = [(0, 1, "Ã", -9.0), (1, 2, "©", -9.0), (2, 4, "t�", -9.0), (2, 4, "tà", -3.0), (0, 4, "été", -4.0), (0, 2, "é", -2.0)]
    assert garbled.best_path("Ã©t�", arcs) == "été" and garbled.best_path("Ã©t�", arcs[:4]) == "Ã©tà"


# -- 6 catalogue -------------------------------------------------------------------

FOODS = [(1, "t", "Plum, amber, dried", "c"), (2, "t", "Leek (tender), no salt", "c"), (3, "t", "Chickpeas, roasted", "c"), (4, "t", "Beet, tender", "c"), (5, "t", "Blueberry, tart, dried", "c"), (6, "t", "Arugula, winter", "c")]


NAMES = [
    ("Plum, amber, dried", 1), ("dried amber plums", 1), ("AMBRE  plum *", 1), ("amb. plum", 1), ("tender-leeks", 2), ("the best tender leek", 2), ("roasted garbanzo beans", 3), ("tender beetroot", 4),
    ("tart blueberrise", 5), ("rocket / winter", 6), ("amber leek", -1), ("plum", -1), ("parchment paper", -1), ("???", -1), ("tndr leek", 2), ("x" * 3000, -1),
]


def test_names(spark):
    foods = spark.createDataFrame([*FOODS, (7, "t", "Olive oil, extra virgin, cold pressed", "c")], "fdc_id int, data_type string, description string, category string")
    # Food and qualifier may have several words; all of them are needed.
    cases = [*NAMES, ("extra virgin olive oil", 7), ("oil olive, virgn extra", 7), ("olive oil", -1)]
    names = spark.createDataFrame([(i, text, None) for i, (text, _) in enumerate(cases)], "text_id long, text string, loaded_at timestamp")
    got = {r.text_id: r.fdc_id for r in canon.found(names, foods).collect()}
    assert {cases[i][0]: x for i, x in got.items()} == dict(cases)
    none = canon.found(names, foods, aliases=canon.alias_table(spark, {"courgette": "leek"})).collect()
    assert {cases[r.text_id][0]: r.fdc_id for r in none}["rocket / winter"] == -1


def test_name_tables(spark):
    foods = spark.createDataFrame(FOODS, "fdc_id int, data_type string, description string, category string")
    schema = "text_id long, text string, at string, n long"
    names = spark.createDataFrame([(1, "x", "2024-01-01", 0), (1, "amber plum", "2024-02-01", 0), (2, None, None, 0), (3, " ", None, 0), (4, "what", None, 0), (5, "what", None, 0)], schema).withColumn("loaded_at", F.to_timestamp("at"))
    assert pairs(canon.found(names, foods)) == {(1, 1), (4, -1), (5, -1)}
    assert [tuple(r) for r in canon.unmatched(names, foods).collect()] == [("what", 2)]
    assert canon.found(names.limit(0), foods).count() == 0 and {r.fdc_id for r in canon.found(names, foods.limit(0)).collect()} == {-1}


def test_similar_words_match_brute_force(spark):
    typed, listed = ["amber", "ambre", "aber", "umbra", "plum", "plumm", "zzz", "a"], ["amber", "plum", "tender"]

    def els(w):
        seen: dict = {}
        out = set()
        for c in w:
            seen[c] = seen.get(c, 0) + 1
            out.add(c + str(seen[c]))
        return out | {"_" + x for x in map("".join, zip(f"<{w}>", f"<{w}>"[1:]))}

    want = {(a, b) for a in typed for b in listed if jaccard(els(a), els(b)) >= 0.3}
    got = canon.similar_words(spark.createDataFrame([(w,) for w in typed], "word string"), spark.createDataFrame([(w,) for w in listed], "other string"))
    assert {(r.word, r.other) for r in got.collect()} == want


# -- 7 overlaps between splits -----------------------------------------------------


def _distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(0, 6))
@settings(max_examples=300, deadline=None)
def test_bounded_distance(a, b, k):
    assert cross.bounded_distance(a, b, k) == min(_distance(a, b), k + 1)


@pytest.mark.parametrize("k", [1, 3, 6])
def test_edit_pairs_match_brute_force(spark, k):
    rng = random.Random(k)
    base = ["".join(rng.choice("ab é") for _ in range(rng.randint(1, 40))).strip() or "a" for _ in range(25)]
    sents = [*base]
    for b in base:
        for _ in range(3):
            e = list(b)
            for _ in range(rng.randint(0, k + 1)):
                at = rng.randrange(len(e) + 1)
                e[at:at + rng.choice([0, 1])] = rng.choice(["", "x", "a"])
            sents.append("".join(e) or "b")
    splits = {i: rng.choice(["train", "train", "val", "test", None]) for i in range(1, len(sents) + 1)}
    first: dict = {}
    for i, s in enumerate(sents, 1):
        if s.strip() and splits[i]:
            first.setdefault((s, splits[i] == "train"), i)
    want = {(i, j, _distance(a, b)) for (a, t), i in first.items() if t for (b, u), j in first.items() if not u and _distance(a, b) <= k}
    got = cross.edit_pairs(rows(spark, sents, splits), k=k).collect()
    assert {(r.id_a, r.id_b, r.distance) for r in got if r.kind == "pair"} == want and want
    reps = {r.id_b: r.id_a for r in got if r.kind == "member"}
    assert all(sents[a - 1] == sents[b - 1] and (splits[a] == "train") == (splits[b] == "train") and a < b for b, a in reps.items())


def test_cross_found_and_report(spark):
    sents = ["2 cups red onion, chopped", "chopped, 2 cups red onion", "2 cups red onion, sliced", "2 cups rеd onion, chopped", "a b c", "2 cups red onion, chopped", "q r s"]
    splits = {1: "train", 2: "val", 3: "test", 4: "val", 5: "test", 6: None, 7: "train"}
    df = rows(spark, sents, splits, {2: None, 4: None})
    assert pairs(cross.found(df)) == {(1, 2), (1, 3), (1, 4)}
    assert {(r.split, r.source, r.n_rows, r.n_train, r.n_pairs) for r in cross.report(df).collect()} == {("val", None, 2, 1, 2), ("test", "src", 1, 1, 1)}


# -- 8 leaks -----------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_automaton_matches_brute_force(seed):
    rng = random.Random(seed)
    items = [(i, [rng.choice("abcd") for _ in range(rng.randint(1, 25))]) for i in range(6)]
    least = rng.randint(2, 6)
    auto = leaks.Automaton([(i, len(w), w) for i, w in items], least)
    for _ in range(60):
        doc = [rng.choice("abcde") for _ in range(rng.randint(0, 60))]
        runs = lambda w: {tuple(w[i:i + least]) for i in range(len(w) - least + 1)}
        got = auto.matches(doc)
        assert {i for i, _, _ in got} == {i for i, w in items if runs(w) & runs(doc)}
        for i, at, n in got:
            w = dict(items)[i]
            assert n >= least and all(tuple(doc[k:k + least]) in runs(w) for k in range(at, at + n - least + 1))


def test_leaks(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    short = " ".join(f"s{i}" for i in range(19))
    items = spark.createDataFrame([(1, passage), (2, short), (3, None), (4, passage + " more")], "item_id long, text string")
    half = " ".join(f"w{i}" for i in range(5, 25))
    docs = [(1, f"intro\n# {passage.upper()}!\nend"), (2, "x " + half.replace(" ", " -- ") + " y"), (3, " ".join(f"w{i}" for i in range(19))), (4, None), (5, ""), (6, short), (7, "z" * 50000 + " " + passage)]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, id long")
    assert pairs(leaks.found(df, items)) == {(d, i) for d in (1, 2, 7) for i in (1, 4)}
    assert leaks.found(df.limit(0), items).count() == 0 and leaks.found(df, items.limit(0)).count() == 0
    got = {r.doc_id: (r.text, r.n_removed) for r in leaks.cleaned(df, items, max_cover=0.8).collect()}
    assert got[1][0] == "intro\n# !\nend" and got[6][0] == "" and got[4] == (None, 0) and got[3][1] == 0 and len(got) == 7
    assert {r.item_id: r.longest for r in leaks.report(df, items).collect()} == {1: 30, 4: 30}


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 40)
    monkeypatch.setattr(leaks, "PIECE_WORDS", 15)
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(50))) for i in range(4)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(13 + i, 35 + i))) for i in range(4)], "doc_id long, text string")
    assert pairs(leaks.found(docs, items)) == {(i, i) for i in range(4)}


# -- 9 mixing ----------------------------------------------------------------------


def _mix(spark, counts, targets, **options):
    c = spark.createDataFrame(counts, "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    chosen = mixing.choose(c, t, **options)
    return {r.doc_id: r.repeats for r in chosen.collect()}, {r.source: r for r in mixing.shares(chosen, t).collect()}


def test_mix_meets_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    monkeypatch.setattr(mixing, "RANGES", 3)
    rng = random.Random(2)
    counts = [(i, "big" if i < 900 else "small" if i < 960 else None, rng.randint(0, 50)) for i in range(1000)]
    repeats, shares = _mix(spark, counts, [("big", 0.7, 1), ("small", 0.3, 4), ("none", 0.0, 1)])
    sizes = {i: n for i, _, n in counts}
    total = sum(sizes[i] * r for i, r in repeats.items())
    for source, share, cap in (("big", 0.7, 1), ("small", 0.3, 4)):
        ids = [i for i, s, _ in counts if s == source]
        assert abs(sum(sizes[i] * repeats.get(i, 0) for i in ids) / total - share) < 0.01
        assert max(repeats.get(i, 0) for i in ids) <= cap and max(repeats.get(i, 0) for i in ids) - min(repeats.get(i, 0) for i in ids) <= 1
        assert shares[source].actual_share == pytest.approx(share, abs=0.01)
    assert not set(repeats) & {i for i, s, _ in counts if s is None}
    assert _mix(spark, counts[::-1], [("big", 0.7, 1), ("small", 0.3, 4)])[0] == repeats


def test_mix_edges(spark):
    assert _mix(spark, [], [("a", 1.0, 1)])[0] == {}
    repeats, shares = _mix(spark, [(1, "a", 10)], [("a", 0.5, 2), ("b", 0.5, 1)])
    assert repeats == {1: 2} and shares["b"].n_tokens == 0
    repeats, _ = _mix(spark, [(1, "a", 10), (2, "a", 10)], [("a", 1.0, 9)], total_tokens=50)
    assert sorted(repeats.values()) == [2, 3]


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world", "s"), (2, None, "s"), (3, "", None)], "doc_id long, text string, source string")
    assert {r.doc_id: r.n_tokens for r in mixing.counted(df).collect()} == {1: 2, 2: 0, 3: 0}


# -- 10 cut-off texts --------------------------------------------------------------


def _document(rng):
    parts = []
    for _ in range(rng.randint(2, 6)):
        parts.append(rng.choice([
            lambda: " ".join(f"The {rng.choice(['odd', 'late', 'simple'])} {rng.choice(['window', 'kernel', 'table'])} shows the {rng.choice(['label', 'price'])} of each row." for _ in range(rng.randint(1, 4))),
            lambda: f"```\nvalue = load(\"file_{rng.randint(1, 99)}.csv\", rows={rng.randint(1, 99)})\nprint(value.head({rng.randint(1, 9)}))\n```",
            lambda: "- first point\n- second point",
            lambda: "```\n" + "\n".join(f"{i}   {rng.uniform(1, 99):.2f}   {rng.uniform(1, 99):.2f}" for i in range(4)) + "\n```",
        ])())
    return "\n\n".join(parts)


def test_cut_texts_are_told_from_whole_ones(spark):
    rng = random.Random(11)
    whole = [_document(rng) for _ in range(700)]
    data, cut = [], set()
    for i, t in enumerate(whole):
        if i % 10 == 0:
            at = cutoff._cut_at(t, rng.getrandbits(24))
            t, cut = t[:at], cut | {i}
        data.append((i, t, "s"))
    data += [(9001, None, "s"), (9002, " ", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r.doc_id for r in cutoff.found(df).collect()}
    assert len(got & cut) >= 0.9 * len(cut) and len(got - cut) <= 0.02 * len(whole)
    rep = {r.source: r for r in cutoff.report(df).collect()}
    assert rep["s"].n_docs > 690 and rep["s"].n_cut == len(got)


def test_cutoff_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert cutoff.found(df).count() == 0
    one = spark.createDataFrame([(1, "x" * 100000, None)], "doc_id long, text string, source string")
    assert cutoff.scored(one).count() == 1
    assert cutoff._container('{"a": 1}') == "closed" and cutoff._container('{"a": [1') == "open" and cutoff._container("text") == ""


def test_marks_opened_far_before_the_end_are_seen():
    call = "value = load(\n" + "".join(f"    {i}, 0.5,\n" for i in range(2000))
    assert len(call) > 20000
    assert "open in(" in cutoff.features(call + "    7, 0.") and "open in(" not in cutoff.features(call + "    7)")
    block = 'text = """\n' + "x = [1, 2]\n" * 1000
    assert 'open quote"""' in cutoff.features(block + "  y = (1") and 'open quote"""' not in cutoff.features(block + '  """)')


def test_fit_separates():
    rows_ = [([1, 2], 1), ([1, 3], 0)] * 50
    w = cutoff.fit(rows_)
    assert w[1] + w[2] > 0 > w[1] + w[3] and np.isfinite(w).all()

"""Token tables and token features.

A token table is long: one row per ``sent_id, idx``.  Windows run over
``sent_id`` only, so one shuffle by sentence serves all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import tokens as tk
from quern.functions import vocab
from quern.functions.normalise import normalise, singular_unit
from quern.runtime import lookup

# Tags of closed-class words for the fallback tagger; fixed values.
_CLOSED = {
    "IN": "of from for in with as like at on by about into without until per over under such".split(),
    "DT": "a an the any each every some this that these those".split(),
    "CC": "and or and/or but nor plus minus".split(),
    "TO": ["to"],
    "PRP": "you it they your their".split(),
}
_JJ = "red green white black brown fresh dried raw wild young dark light low-fat organic mild firm ripe unsalted large small medium sweet hot plain whole".split()


def rule_pos(c: Column) -> Column:
    """A part-of-speech tag by closed-class lists and endings, for tokens that no table has."""
    low = F.lower(c)
    tag = F.when(c.rlike(r"^[^\p{L}\p{N}]+$"), c)
    for name, words in _CLOSED.items():
        tag = tag.when(low.isin(words), name)
    tag = tag.when(low.isin(_JJ), "JJ").when(low.rlike("ly$"), "RB").when(low.rlike("ing$"), "VBG").when(low.rlike("ed$"), "VBN")
    return tag.when(low.rlike("[^su]s$"), "NNS").otherwise("NN")


def fixed_pos(text: Column, tag: Column) -> Column:
    """The tags that certain tokens always have."""
    low = F.lower(text)
    return F.when(tk.is_numeric(text), "CD").when(low.isin("c", "g"), "NN").when(low.isin("and/or", "or", "and"), "CC").when(low == "e.g.", "IN").otherwise(tag)


def token_table(df: DataFrame, id_col: str, sentence_col: str, tags: DataFrame | None = None, normalised: bool = False) -> DataFrame:
    """``sent_id, idx, raw, text, feat_text, pos, stem, shape, is_capitalised, is_unit, is_punc, is_ambiguous, n_tokens``.

    ``tags`` (``token, tag``) overrides the rule tagger.  Units are in the
    singular in ``text``; numbers are ``!num`` in ``feat_text``.  Sentences
    that are null or blank have no tokens.
    """
    c = F.col(sentence_col) if normalised else normalise(F.col(sentence_col))
    rows = df.select(F.col(id_col).alias("sent_id"), tk.tokenise(c).alias("tokens"))
    return describe(rows.select("sent_id", F.size("tokens").alias("n_tokens"), F.posexplode("tokens").alias("idx", "raw")), tags)


def describe(long: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """``token_table`` from ``sent_id, n_tokens, idx, raw``."""
    long = long.withColumn("text", singular_unit(F.col("raw")))
    tag = rule_pos(F.col("raw"))
    if tags is not None:
        uses = long.groupBy("raw").agg(F.count(F.lit(1)).alias("uses"))
        table = tags.groupBy(F.col("token").alias("raw")).agg(F.min("tag").alias("tag")).join(uses, "raw")
        long = lookup(long, table, "raw", "uses", F.xxhash64("sent_id", "idx"))
        tag = F.coalesce("tag", tag)
    feat = F.when(F.col("raw").isin(list(vocab.UNITS)), F.col("text")).when(tk.is_numeric(F.col("text")), "!num").otherwise(F.col("text"))
    long = long.withColumn("feat_text", feat).withColumn("pos", fixed_pos(F.col("text"), tag))
    f = F.col("feat_text")
    return long.select(
        "sent_id", "idx", "raw", "text", "feat_text", "pos", tk.stem(f).alias("stem"), tk.word_shape(f).alias("shape"),
        tk.is_capitalised(f).alias("is_capitalised"), tk.is_unit(f).alias("is_unit"), tk.is_punctuation(f).alias("is_punc"),
        tk.is_ambiguous_unit(f).alias("is_ambiguous"), "n_tokens",
    )


def context(tokens: DataFrame) -> DataFrame:
    """Adds ``in_parens, after_comma, after_plus`` to a table with ``sent_id, idx, feat_text``.

    Brackets pair by order, round and square ones alike: the k-th opening
    one with the k-th closing one.
    """
    w = Window.partitionBy("sent_id")
    before = w.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    f = F.col("feat_text")
    opened = F.coalesce(F.sum(f.isin("(", "[").cast("int")).over(before), F.lit(0))
    closed = F.coalesce(F.sum(f.isin(")", "]").cast("int")).over(before), F.lit(0))
    closings = F.sum(f.isin(")", "]").cast("int")).over(w)
    out = tokens.withColumn("_o", opened).withColumn("_c", closed).withColumn("_n", closings)
    out = out.withColumn("in_parens", f.isin("(", ")", "[", "]") | (F.col("_c") < F.least("_o", "_n")))
    out = out.withColumn("after_comma", F.coalesce(F.max(f == ",").over(before), F.lit(False)))
    return out.withColumn("after_plus", F.coalesce(F.max(F.lower(f) == "plus").over(before), F.lit(False))).drop("_o", "_c", "_n")


_STRUCTURE = ("mip_start", "mip_end", "after_sentence_split", "example_phrase")
_COMMON = (("is_capitalised", "is_capitalised"), ("is_unit", "is_unit"), ("is_punc", "is_punc"), ("is_ambiguous", "is_ambiguous"), ("is_in_parens", "in_parens"), ("is_after_comma", "after_comma"), ("is_after_plus", "after_plus"), ("word_shape", "shape"))


def feature_maps(tokens: DataFrame) -> DataFrame:
    """``sent_id, idx, features``: a map per token, keys only where they apply.

    ``tokens``: ``token_table`` with ``context`` and, if there, the columns of
    ``structure.token_flags``.
    """
    w = Window.partitionBy("sent_id").orderBy("idx")
    flags = [c for c in _STRUCTURE if c in tokens.columns]
    own = F.struct("pos", "stem", *[F.col(c).alias(k) for k, c in _COMMON], *flags)
    near = {0: own} | {d: F.lag(own, -d).over(w) for d in (-3, -2, -1, 1, 2, 3)}
    rows = tokens.select("sent_id", "idx", "n_tokens", "feat_text", *[x.alias(f"_{d + 3}") for d, x in near.items()])
    at = lambda d: F.col(f"_{d + 3}")
    pairs: list[tuple[str, Column]] = [("bias", F.lit("")), ("sentence_length", tk.length_bucket(F.col("n_tokens")).cast("string"))]
    f = F.col("feat_text")
    pairs += [("pos", at(0)["pos"]), ("stem", at(0)["stem"]), ("token", F.when(f != at(0)["stem"], f))]
    for n in (3, 4, 5):
        pairs += [(f"prefix_{n}", tk.affix(f, n, False)), (f"suffix_{n}", tk.affix(f, n, True))]
    for d, prefix in ((0, ""), (-1, "prev_"), (-2, "prev2_"), (-3, "prev3_"), (1, "next_"), (2, "next2_"), (3, "next3_")):
        if d:
            run = range(d, 1) if d < 0 else range(0, d + 1)
            there = at(d).isNotNull()
            pairs += [(prefix + "stem", at(d)["stem"]), (prefix + "pos", at(d)["pos"])]
            pairs.append((prefix + "pos_ngram", F.when(there, F.concat_ws("+", *[at(k)["pos"] for k in run]))))
        for k in [k for k, _ in _COMMON] + flags:
            pairs.append((prefix + k, at(d)[k].cast("string")))
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
    return rows.select("sent_id", "idx", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("features"))


def select_features(features: DataFrame, discard: list[str]) -> DataFrame:
    """Without the named keys."""
    return features.withColumn("features", F.map_filter("features", lambda k, _: ~k.isin(discard)))


def attributes(features: DataFrame) -> DataFrame:
    """``sent_id, idx, attr``: ``key=value`` for strings, the key for true flags; false flags vanish."""
    rows = features.select("sent_id", "idx", F.explode("features").alias("key", "value")).where("value <> 'false'")
    return rows.select("sent_id", "idx", F.when(F.col("value") == "true", F.col("key")).otherwise(F.concat_ws("=", "key", "value")).alias("attr"))


def islands(rows: DataFrame, by: list[str], idx: str = "idx") -> DataFrame:
    """Adds ``island``: rows of one group with consecutive ``idx`` share a number."""
    w = Window.partitionBy(*by).orderBy(idx)
    return rows.withColumn("island", F.col(idx) - F.row_number().over(w))

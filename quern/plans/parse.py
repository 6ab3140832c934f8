"""Sentences to records, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.vocab import LABELS
from quern.operators import assemble, catalogue, crf, features, structure, tagger
from quern.runtime import materialise, with_values


def labelled(df: DataFrame, id_col: str, sentence_col: str, state_w: DataFrame, trans_w: DataFrame, tags: DataFrame | None = None, labels: list[str] = LABELS, expect_name: bool = True) -> DataFrame:
    """``sent_id, sentence, raw, text, pos, labels, scores, marginals``, null where a sentence has no token.

    With rule tags and a model that executors can hold everything is done row
    by row.  A table of tags, or of weights beyond that bound, is joined to
    the tokens instead; both ways give the same.
    """
    if tags is None and tagger.small(state_w):
        rows = tagger.tagged(tagger.described(df, id_col, sentence_col), state_w, trans_w, labels)
        rows = rows.select("sent_id", "sentence", "raw", "text", "pos", "labels", "scores", "marginals")
    else:
        tokens = materialise(structure.token_flags(features.context(features.token_table(df, id_col, sentence_col, tags))))
        attributes = materialise(features.attributes(features.feature_maps(tokens)))
        decoded = crf.tag(attributes, state_w, trans_w, labels)
        packed = F.array_sort(F.collect_list(F.struct("idx", "raw", "text", "pos")))
        rows = tokens.groupBy("sent_id").agg(packed.alias("t")).select("sent_id", "t.raw", "t.text", "t.pos").join(decoded, "sent_id")
        rows = df.select(F.col(id_col).alias("sent_id"), F.col(sentence_col).alias("sentence")).join(rows, "sent_id", "left")
    return crf.guess_names(rows, labels) if expect_name else rows


def inspect(df: DataFrame, id_col: str, sentence_col: str, state_w: DataFrame, trans_w: DataFrame, tags: DataFrame | None = None, labels: list[str] = LABELS, expect_name: bool = True, **options: bool) -> DataFrame:
    """``sent_id, sentence, raw, tokens, tags, labels, scores, marginals, record``: a row per sentence.

    Units that are not labelled UNIT get their written form back.
    """
    rows = labelled(df, id_col, sentence_col, state_w, trans_w, tags, labels, expect_name)
    tokens = crf.plural_tokens(F.col("raw"), F.col("text"), F.col("labels"))
    rows = with_values(rows, tokens=tokens)
    rows = rows.select("sent_id", "sentence", "raw", "tokens", F.col("pos").alias("tags"), "labels", "scores", "marginals")
    return rows.withColumn("record", assemble.record(F.col("tokens"), F.col("tags"), F.col("labels"), F.col("scores"), **options))


def parse(df: DataFrame, id_col: str, sentence_col: str, state_w: DataFrame, trans_w: DataFrame, tags: DataFrame | None = None, labels: list[str] = LABELS, expect_name: bool = True, **options: bool) -> DataFrame:
    """``sent_id, sentence`` and the fields of the record.

    Every input row with an id comes out; a sentence that is null or blank
    has null fields.  Options are those of ``assemble.Options``.
    """
    return inspect(df, id_col, sentence_col, state_w, trans_w, tags, labels, expect_name, **options).select("sent_id", "sentence", "record.*")


def with_foods(parsed: DataFrame, foods: DataFrame, vectors: DataFrame, overrides: DataFrame | None = None, **options) -> DataFrame:  # noqa: ANN003
    """Adds ``foundation_foods`` to ``parse``: a catalogue entry for each name that matches one, no entry twice.

    ``foods``: ``fdc_id, data_type, description, category, tokens`` (stems).
    Each distinct name is matched once.
    """
    names = parsed.select("sent_id", F.posexplode("name").alias("name_index", "n")).select("sent_id", "name_index", F.lower("n.text").alias("qid"))
    words = F.split("qid", r"\s+")
    asked = names.select("qid").distinct().select("qid", catalogue.content_tokens(words, catalogue.stems(words)).alias("tokens"))
    hit = catalogue.match(asked, foods.select("fdc_id", "tokens"), vectors, overrides, **options)
    full = names.join(hit, "qid").join(foods.drop("tokens"), "fdc_id")
    full = full.groupBy("sent_id", "fdc_id").agg(F.min_by(F.struct(F.col("description").alias("text"), "confidence", "fdc_id", "category", "data_type", catalogue.food_url(F.col("fdc_id")).alias("url"), "name_index"), "name_index").alias("f"))
    found = full.groupBy("sent_id").agg(F.array_sort(F.collect_list("f"), lambda a, b: F.coalesce(F.nullif(F.sign(a["name_index"] - b["name_index"]).cast("int"), F.lit(0)), F.sign(a["fdc_id"] - b["fdc_id"]).cast("int"))).alias("foundation_foods"))
    return parsed.join(found, "sent_id", "left")

"""Copies that differ only in formatting, by dictionary-encoded pieces.

A sentence is the multiset of its comma- or semicolon-separated pieces; a
piece counts by its letters, numbers, marks and invisible characters in lower
case.  Each distinct piece is canonicalised once and gets an integer; a
sentence becomes the sorted tuple of its integers and equal tuples are one
record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import blank, letters, rows_of
from quern.runtime import lookup, materialise


def piece_tuples(texts: DataFrame) -> DataFrame:
    """``sid, tuple`` of ``sid, text`` (distinct texts, none blank)."""
    raw = texts.select("sid", F.explode(F.split("text", "[,;]")).alias("piece"))
    spelled = raw.groupBy("piece").agg(F.count(F.lit(1)).alias("uses"))
    spelled = spelled.withColumn("canon", letters(F.col("piece"))).where("canon <> ''")
    # Sorted within its hash partition, so that a task that runs again gives the same numbers.
    codes = spelled.groupBy("canon").agg(F.count(F.lit(1)).alias("ways")).sortWithinPartitions("canon")
    codes = materialise(codes.select("canon", "ways", F.monotonically_increasing_id().alias("code")))
    coded = spelled.join(codes.select("canon", "code"), "canon").select("piece", "code", "uses")
    tuples = lookup(raw, coded, "piece", "uses", F.xxhash64("sid"), how="inner")
    tuples = tuples.groupBy("sid").agg(F.sort_array(F.collect_list("code")).alias("tuple"))
    bare = texts.where(letters(F.col("text")) == "").select("sid", F.array().cast("array<bigint>").alias("tuple"))
    return tuples.unionByName(bare)


def copy_sets(df: DataFrame, id_col: str = "id", text_col: str = "sentence") -> DataFrame:
    """Every row's set of copies: ``id, first_id, n_copies``.

    ``first_id`` is the smallest id of the set and ``n_copies`` the number of
    its rows.  Null and blank texts belong to no set and have no row.  Texts
    without any counted character are copies of each other.  A row that is
    there twice counts twice and comes out twice.  An empty table gives an
    empty result; other columns are ignored.
    """
    rows = rows_of(df, id_col, text_col).where(~blank(F.col("text")))
    texts = materialise(rows.groupBy("text").agg(F.min("id").alias("sid"), F.count(F.lit(1)).alias("n")))
    tuples = materialise(piece_tuples(texts).join(texts.select("sid", "n"), "sid"))
    sets = tuples.groupBy("tuple").agg(F.min("sid").alias("first_id"), F.sum("n").alias("n_copies"), F.count(F.lit(1)).alias("ways"))
    member = lookup(tuples.select("sid", "tuple"), sets, "tuple", "ways", F.xxhash64("sid")).select("sid", "first_id", "n_copies")
    named = texts.join(member, "sid").select("text", "n", "first_id", "n_copies")
    return lookup(rows, named, "text", "n", F.xxhash64("id")).select("id", "first_id", "n_copies")


def collapse(df: DataFrame, id_col: str = "id", text_col: str = "sentence") -> DataFrame:
    """One record per sentence: ``first_id, sentence, n_copies, n_spellings``.

    ``sentence`` is the text of ``first_id``.  Cases as in ``copy_sets``.
    """
    rows = rows_of(df, id_col, text_col).where(~blank(F.col("text")))
    texts = materialise(rows.groupBy("text").agg(F.min("id").alias("sid"), F.count(F.lit(1)).alias("n")))
    tuples = piece_tuples(texts).join(texts, "sid")
    return tuples.groupBy("tuple").agg(
        F.min("sid").alias("first_id"), F.min_by("text", "sid").alias("sentence"),
        F.sum("n").alias("n_copies"), F.count(F.lit(1)).alias("n_spellings"),
    ).drop("tuple")


def found(df: DataFrame, id_col: str = "id", text_col: str = "sentence") -> DataFrame:
    """``first_id, copy_id``: one row per copy besides the first."""
    return copy_sets(df, id_col, text_col).where("id <> first_id").select("first_id", F.col("id").alias("copy_id")).distinct()

"""Amounts and names as windows over long labelled tokens.

``tokens``: ``sent_id, idx, token, label``.  For analytics over large tables;
the full rules, which hand tokens on between steps, are in ``assemble``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vocab


def amount_groups(tokens: DataFrame) -> DataFrame:
    """``sent_id, amount, start, quantity, unit, approximate, singular``.

    Every quantity starts an amount; units go to the last one.  An amount
    right after an opening bracket or a slash belongs to the one before, and
    flags hold for all that belong together.  Units before the first
    quantity are amount 0.
    """
    w = Window.partitionBy("sent_id").orderBy("idx")
    t = tokens.withColumn("_prev", F.lower(F.lag("token").over(w))).withColumn("_next", F.lower(F.lead("token").over(w)))
    t = t.withColumn("amount", F.sum((F.col("label") == "QTY").cast("int")).over(w))
    t = t.where(F.col("label").isin("QTY", "UNIT"))
    qty, unit = F.col("label") == "QTY", F.col("label") == "UNIT"
    words = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("idx", "token")))), lambda x: x["token"]), " ")
    a = t.groupBy("sent_id", "amount").agg(
        F.min("idx").alias("start"), words(qty).alias("quantity"), words(unit).alias("unit"),
        F.coalesce(F.max(qty & F.col("_prev").isin(vocab.APPROXIMATE)), F.lit(False)).alias("_a"),
        F.coalesce(F.max(unit & F.col("_next").isin(vocab.SINGULAR)), F.lit(False)).alias("_s"),
        F.coalesce(F.max(qty & F.col("_prev").isin("(", "[", "/")), F.lit(False)).alias("_linked"),
    )
    group = F.sum((~F.col("_linked")).cast("int")).over(Window.partitionBy("sent_id").orderBy("amount"))
    a = a.withColumn("_g", group)
    both = Window.partitionBy("sent_id", "_g")
    return a.select("sent_id", "amount", "start", "quantity", "unit", F.max("_a").over(both).alias("approximate"), F.max("_s").over(both).alias("singular"))


def name_groups(tokens: DataFrame) -> DataFrame:
    """``sent_id, part, kind, start, text``: runs of name labels.

    A run ends at a separator, at a ``B_`` label and where modifier or
    variant begin; ``kind`` is TOK, VAR or MOD.
    """
    w = Window.partitionBy("sent_id").orderBy("idx")
    t = tokens.where(F.col("label").contains("NAME")).withColumn("_prev", F.lag("label").over(w))
    label = F.col("label")
    begins = label.startswith("B_") | (label == "NAME_SEP") | F.col("_prev").isNull() | (F.col("_prev") == "NAME_SEP") | (label.isin("NAME_MOD", "NAME_VAR") & (F.col("_prev") != label))
    t = t.withColumn("part", F.sum(begins.cast("int")).over(w)).where(label != "NAME_SEP")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "token"))), lambda x: x["token"]), " ")
    kind = F.min_by(F.regexp_extract("label", "([A-Z]+)$", 1), "idx")
    return t.groupBy("sent_id", "part").agg(kind.alias("kind"), F.min("idx").alias("start"), text.alias("text"))

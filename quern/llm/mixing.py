"""Sources mixed to target shares of all tokens.

Every document gets a hash-random key; within its source the documents are
put in key order and their token counts summed up by distributed prefix sums
(hash ranges of a few thousand rows, then ranges of ranges), so that no
source, however large, is sorted in one task.  The source is cut where its
budget ends; a source that is too small is taken in whole epochs first.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.runtime import lookup, materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Splits of the public byte-level vocabulary; fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of one hash range, and ranges of one range of ranges.
RANGE_ROWS, RANGES = 5_000, 1_000


def token_counter(spark: SparkSession, path: str = TOKENIZER):  # noqa: ANN201
    """A UDF that counts tokens.  The vocabulary file (below 1 MB) is read on the driver and broadcast."""
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        code = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([len(code.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count


def counted(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens``; null text has 0 tokens."""
    rows = docs.select(F.col(doc_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    count = token_counter(docs.sparkSession, path)
    return rows.select("doc_id", "source", count("text").alias("n_tokens"))


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """``source, target_share, max_repeats, n_docs, n_tokens, budget``.

    ``sizes``: ``source, n_docs, n_tokens``.  Without ``total_tokens`` the mix
    is as large as the caps allow: the smallest of max_repeats * n_tokens /
    target_share over the sources that have tokens and a share.  A source of
    the targets without tokens gets the budget 0; it does not shrink the mix.
    With ``total_tokens``, a source's budget ends at its cap.
    """
    goal = targets.select(F.col("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("bigint")).where("source is not null")
    both = goal.join(sizes, "source", "left").na.fill(0, ["n_docs", "n_tokens"])
    cap = F.col("max_repeats") * F.col("n_tokens")
    reach = total_tokens
    if reach is None:
        reach = both.where((cap > 0) & (F.col("target_share") > 0)).agg(F.min(cap / F.col("target_share"))).first()[0]
    want = F.floor(F.col("target_share") * F.lit(float(reach or 0)) + 1e-6)
    return both.select(*both.columns, F.least(want, cap).cast("bigint").alias("budget"))


def choose(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """``doc_id, source, n_tokens, repeats``: the documents of the mix.

    ``counts`` as of ``counted``.  Documents of other sources and of a null
    source are not chosen.  A document without tokens takes part like any
    other.  Ties of the random key are broken by doc_id; the choice depends
    on ids, sizes and ``seed`` only.  No source exceeds its budget; it stays
    short of it by less than the document at which it is cut.
    """
    counts = materialise(counts)
    sizes = materialise(counts.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens")))
    plan = materialise(budgets(sizes, targets, total_tokens))
    part = plan.select("source", "n_docs", "budget", F.col("n_tokens").alias("_all"), F.ceil(F.col("n_docs") / RANGE_ROWS).cast("bigint").alias("_n"))
    key = F.xxhash64("doc_id", F.lit(seed))
    place = F.shiftrightunsigned(key, 33)
    rows = lookup(counts, part, "source", "n_docs", F.xxhash64("doc_id"), how="inner").withColumn("_key", place).withColumn("_r", F.shiftright(place * F.col("_n"), 31))
    ranges = rows.groupBy("source", "_r").agg(F.sum("n_tokens").alias("_sum"))
    ranges = ranges.withColumn("_rr", F.floor(F.col("_r") / RANGES))
    upper = ranges.groupBy("source", "_rr").agg(F.sum("_sum").alias("_sum"))
    before = (Window.unboundedPreceding, -1)
    upper = upper.select("source", "_rr", F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_rr").rowsBetween(*before)), F.lit(0)).alias("_u"))
    within = F.coalesce(F.sum("_sum").over(Window.partitionBy("source", "_rr").orderBy("_r").rowsBetween(*before)), F.lit(0))
    starts = ranges.withColumn("_w", within).join(upper, ["source", "_rr"]).select("source", "_r", (F.col("_w") + F.col("_u")).alias("_start"))
    running = F.sum("n_tokens").over(Window.partitionBy("source", "_r").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.join(starts, ["source", "_r"]).withColumn("_end", F.col("_start") + running)
    epochs = F.when(F.col("_all") > 0, F.expr("budget div _all")).otherwise(F.lit(0))
    rest = F.col("budget") - epochs * F.col("_all")
    placed = placed.withColumn("repeats", (epochs + ((rest > 0) & (F.col("_end") <= rest)).cast("bigint")).cast("int"))
    return placed.where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: ``source, target_share, n_docs, n_tokens, actual_share, most_repeats``."""
    used = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("most_repeats"))
    goal = targets.select("source", "target_share").where("source is not null")
    both = materialise(goal.join(used, "source", "left").na.fill(0, ["n_docs", "n_tokens", "most_repeats"]))
    total = both.agg(F.sum("n_tokens")).first()[0] or 1
    return both.withColumn("actual_share", F.col("n_tokens") / F.lit(total))

"""Expressions and joins that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.runtime import lookup, materialise, stored

#: White space in Unicode's sense, as a Java character class body.
SPACES = r"\p{Z}\t\n\x0B\f\r\x85"


def blank(c: Column) -> Column:
    """True for null and for text of white space only."""
    return c.isNull() | ~c.rlike(f"[^{SPACES}]")


def letters(c: Column) -> Column:
    """Lower case without white space, punctuation and symbols; letters,
    numbers, combining marks and invisible characters stay."""
    return F.regexp_replace(F.lower(c), rf"[{SPACES}\p{{P}}\p{{S}}]+", "")


def word_list(c: Column) -> Column:
    """Maximal runs of letters and digits in lower case, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def rows_of(df: DataFrame, id_col: str, text_col: str, **more: str) -> DataFrame:
    """``id`` (bigint), ``text`` and the columns named in ``more``: whatever
    else the input holds, clashing names included, is left behind."""
    cols = [F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")]
    return df.select(*cols, *[F.col(v).alias(k) for k, v in more.items()])


def key128(c: Column) -> Column:
    """A 128-bit key of a text or of bytes; equal keys mean equal values, but for accidents of one in 10**19 even among 10**10 values."""
    return F.unhex(F.md5(c))


def expand(pairs: DataFrame, members: DataFrame, others: DataFrame | None = None, block: int = 256) -> DataFrame:
    """Pairs of classes to pairs of their members.

    ``pairs``: ``u``, ``v`` (class ids, each pair once); ``members``:
    ``u``, ``id`` and other columns, which come out as ``x_a``, ``x_b``.
    ``others`` holds the members of ``v`` where they are not the same table.
    Members are packed in arrays of about ``block``, so a pair of large
    classes is spread over many rows, and a class in very many pairs is
    spread by ``lookup``.  The result has each pair of members once per pair
    of classes, ``a`` from ``u`` and ``b`` from ``v``.
    """
    pairs = stored(pairs)
    for rows, cls, other, x in ((members, "u", "v", "a"), (members if others is None else others, "v", "u", "b")):
        uses = pairs.groupBy(F.col(cls).alias("u")).agg(F.count(F.lit(1)).alias("_uses"))
        blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
        sizes = materialise(rows.groupBy("u").agg(F.count(F.lit(1)).alias("_n")).join(uses, "u").withColumn("_m", blocks))
        item = F.struct(*[F.col(c).alias(f"{c}_{x}") for c in rows.columns if c != "u"])
        if sizes.agg(F.coalesce(F.max("_m"), F.lit(1))).first()[0] == 1:
            packed = rows.join(sizes.select("u", "_uses"), "u").groupBy("u", "_uses").agg(F.collect_list(item).alias(f"_{x}"))
            packed = packed.withColumnRenamed("u", cls)
            pairs = lookup(pairs, packed, cls, "_uses", F.xxhash64(other), how="inner")
        else:
            sized = lookup(rows, sizes, "u", "_n", F.xxhash64("id"), how="inner")
            sized = sized.withColumn("_i", F.pmod(F.xxhash64("id"), F.col("_m")).cast("int"))
            packed = sized.groupBy(F.struct("u", "_i").alias("_key"), "_uses").agg(F.collect_list(item).alias(f"_{x}"))
            # Blocks of one class that are looked up by each of its pairs.
            keyed = lookup(pairs, sizes.select(F.col("u").alias(cls), "_m", "_uses"), cls, "_uses", F.xxhash64(other), how="inner")
            keyed = keyed.withColumn("_i", F.explode(F.expr("sequence(0, _m - 1)"))).withColumn("_key", F.struct(F.col(cls).alias("u"), "_i"))
            pairs = lookup(keyed.drop("_m", "_i"), packed, "_key", "_uses", F.xxhash64(other), how="inner").drop("_key")
        if x == "a":
            pairs = materialise(pairs)
    pairs = pairs.select(F.explode("_a").alias("_a"), "_b").select("_a.*", F.explode("_b").alias("_b"))
    return pairs.select(*[c for c in pairs.columns if c != "_b"], "_b.*")


def ordered(pairs: DataFrame) -> DataFrame:
    """``id_a < id_b`` in every row, each pair once."""
    lo, hi = F.least("id_a", "id_b"), F.greatest("id_a", "id_b")
    return pairs.where("id_a <> id_b").select(lo.alias("id_a"), hi.alias("id_b")).distinct()

"""Readers and writers of labelled sentences, catalogues, vectors and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.tokens import labelled

EXPORT = ["name", "quantity", "unit", "size", "preparation", "comment"]
_EXPORT_LABELS = {"name": "NAME", "quantity": "QTY", "unit": "UNIT", "size": "SIZE", "preparation": "PREP", "comment": "COMMENT"}


def labelled_sentences(spark: SparkSession, path: str, sources: list[str] | None = None, fmt: str = "parquet", **options: str) -> DataFrame:
    """Labelled rows of a table; list columns that are JSON text become arrays.

    The filter on ``source`` reaches the scan.
    """
    df = spark.read.format(fmt).options(**options).load(path)
    if sources is not None:
        df = df.where(F.col("source").isin(sources))
    kinds = {"tokens": "array<string>", "labels": "array<string>", "foundation_foods": "array<int>", "sentence_split": "array<int>"}
    types = dict(df.dtypes)
    for c, kind in kinds.items():
        if types.get(c) == "string":
            df = df.withColumn(c, F.from_json(c, kind))
    return df


def from_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table, read in ranges of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def food_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """``fdc_id, data_type, description, category`` of a CSV file, plain or gzip."""
    return spark.read.schema("fdc_id int, data_type string, description string, category string").option("header", True).csv(path)


def write_food_catalogue(df: DataFrame, path: str) -> None:
    df.select("fdc_id", "data_type", "description", "category").write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """``token, vec`` of a word2vec text file, plain or gzip; the header and broken lines are left out."""
    parts = F.split(F.trim("value"), " ")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") > 2)
    vec = F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda x: x.try_cast("float"))
    rows = rows.select(F.get("p", F.lit(0)).alias("token"), vec.alias("vec"))
    return rows.where(~F.exists("vec", lambda x: x.isNull()))


def export_rows(df: DataFrame) -> DataFrame:
    """``id, sentence`` and the text of each label."""
    return df.select("id", "sentence", *[labelled(F.col("tokens"), F.col("labels"), _EXPORT_LABELS[c]).alias(c) for c in EXPORT])


def matched_export(df: DataFrame, csv: DataFrame) -> DataFrame:
    """Rows of ``csv`` (``line, sentence, ...``) with the labelled row of the same
    sentence; of equal sentences the k-th line takes the k-th row by id."""
    own = Window.partitionBy("sentence").orderBy("id")
    other = Window.partitionBy("sentence").orderBy("line")
    left = csv.withColumn("_k", F.row_number().over(other))
    right = df.withColumn("_k", F.row_number().over(own)).select("sentence", "_k", "id")
    return left.join(right, ["sentence", "_k"], "left").drop("_k")


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV, or TSV reports with ``sep``."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)

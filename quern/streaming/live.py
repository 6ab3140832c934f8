"""The row-local parts on streams, and windowed counts over their results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.normalise import normalise
from quern.functions.tokens import tokenise
from quern.operators.assemble import record
from quern.runtime import shared_dir


def tokenised(stream: DataFrame, sentence_col: str = "sentence") -> DataFrame:
    """Adds ``normalised`` and ``tokens``; works alike on batches and streams."""
    out = stream.withColumn("normalised", normalise(F.col(sentence_col)))
    return out.withColumn("tokens", tokenise(F.col("normalised")))


def files(folder: str, name: str) -> str:
    """A pattern for a table that is one file or a folder of files, as streams take no single file."""
    return f"{folder}/{name}.parque[t]"


def run_once(stream: DataFrame) -> DataFrame:
    """Runs a stream over what is there and gives the written result.

    State and output go to the shared folder, so a lost executor or driver
    can go on from the last batch.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/quern-streams/{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs an aggregation in update mode and gives the last state of every key.

    Append mode would keep back windows that the watermark has not passed;
    here the open windows at the end of the input come out as well.  Each
    batch writes its changed rows; of one key those of the latest batch count.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/quern-streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is run again overwrites its own folder.
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/out")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")


def records(stream: DataFrame) -> DataFrame:
    """Adds ``record`` to rows with ``tokens, tags, labels, scores``."""
    return stream.withColumn("record", record(F.col("tokens"), F.col("tags"), F.col("labels"), F.col("scores")))


def counts(stream: DataFrame, time_col: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per tumbling window and ``by``; rows later than ``late`` are not
    waited for, and a window is written once the watermark has passed it."""
    out = stream.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), by, "n")


def sessions(stream: DataFrame, time_col: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions per ``by`` that end after a silence of ``gap``."""
    out = stream.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")

"""Clusters of like sentences, to compare their labels.

TF-IDF over hashed tokens and bisecting k-means.  This is another algorithm
than density clustering, for which Spark has no distributed version: every
sentence belongs to a cluster, there is no noise.
"""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import materialise


def sentence_clusters(df: DataFrame, k: int, features: int = 4096, seed: int = 7) -> DataFrame:
    """``id, cluster, size`` of ``id, tokens``; rows without tokens are left out."""
    rows = materialise(df.where(F.size("tokens") > 0).select("id", F.transform("tokens", F.lower).alias("tokens")))
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features).transform(rows)
    weighted = IDF(inputCol="tf", outputCol="raw").fit(tf).transform(tf)
    unit = Normalizer(inputCol="raw", outputCol="features").transform(weighted).select("id", "features")
    model = BisectingKMeans(k=k, seed=seed, maxIter=8).fit(unit)
    found = model.transform(unit).select("id", F.col("prediction").alias("cluster"))
    sizes = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return found.join(F.broadcast(sizes), "cluster").select("id", "cluster", "size")


def members(clustered: DataFrame, cluster: int) -> DataFrame:
    return clustered.where(F.col("cluster") == cluster).select("id")

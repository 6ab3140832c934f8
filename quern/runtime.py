"""Session helpers and the few physical idioms shared by the operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many of the most frequent keys are spread, each over at most
#: ``HOT_SPREAD`` tasks; their hashes (8 bytes each) are all the driver sees.
HOT_KEYS = 1_000
HOT_SPREAD = 4_096
#: A key with fewer rows than this is never spread, a hot one by one task per so many rows.
HOT_LEAST = 10_000
#: Rows without a key are spread over so many tasks.
NULL_SALT = 997


def local_session(app: str = "quern", cores: str = "8", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUERN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where it is unset and the master is local (tests, a laptop) a
    temporary folder is made and set, so that later calls find the same one;
    on a cluster a folder of one machine would lose rows, so that is an error.
    """
    jsc = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        made = jsc.getCheckpointDir()
        named = made.get() if made.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _sweep() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already
            pass


atexit.register(_sweep)


def materialise(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes ``df`` once to the shared folder and reads it back.

    Unlike ``checkpoint()`` it computes the plan once and keeps columns
    apart, so later scans read only what they need.  The files survive lost
    executors and are removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_stored = True
    return out


def stored(df: DataFrame) -> DataFrame:
    """``df`` if it is a materialised table as it was read back, else materialised."""
    return df if getattr(df, "_quern_stored", False) else materialise(df)


def lookup(big: DataFrame, table: DataFrame, key: str, count: str, spread: Column, how: str = "left") -> DataFrame:
    """Joins ``table`` (one row per ``key``) to ``big`` without skew.

    ``count`` is the column of ``table`` with the key's rows in ``big``.  Keys
    with ``HOT_LEAST`` rows or more are hot: their rows in ``table`` are
    repeated once per salt, their rows in ``big`` are spread over the salts by
    ``spread`` (a hash of their own id).  Any key beyond the ``HOT_KEYS``
    hottest has less than a thousandth of the rows.  Nothing is broadcast.
    Null keys match nothing and are spread as well.  The result has the
    columns of ``big`` and those of ``table`` but ``key`` and ``count``.
    ``table`` is materialised, since its counts are looked at first.
    """
    table = stored(table)
    values = [c for c in table.columns if c not in (key, count)]
    keyed = table.where(F.col(key).isNotNull())
    hot = keyed.where(F.col(count) >= HOT_LEAST).select(F.xxhash64(key).alias("h"), F.col(count).alias("c"))
    hot = hot.orderBy(F.col("c").desc(), "h").limit(HOT_KEYS).collect()
    out = big
    if hot:
        ways = min(HOT_SPREAD, -(-hot[0]["c"] // HOT_LEAST))
        # A cold key with the hash of a hot one is salted on both sides alike.
        is_hot = lambda c: F.xxhash64(c).isin(*sorted({r["h"] for r in hot}))
        salt = F.when(is_hot(key), F.pmod(spread, F.lit(ways)).cast("int"))
        copies = F.explode(F.when(is_hot(key), F.expr(f"sequence(0, {ways - 1})")).otherwise(F.array(F.lit(0))))
        keyed = keyed.select(F.col(key).alias("_k"), copies.alias("_s"), *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)])
    else:
        salt = F.when(F.lit(False), F.lit(0))
        keyed = keyed.select(F.col(key).alias("_k"), F.lit(0).alias("_s"), *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)])
    if how == "left":
        salt = F.when(F.col(key).isNull(), F.pmod(spread, F.lit(NULL_SALT)).cast("int") + HOT_SPREAD).otherwise(F.coalesce(salt, F.lit(0)))
        out = out.withColumn("_salt", salt)
        match = (F.col(key) == F.col("_k")) & (F.col("_salt") == F.col("_s"))
    elif hot:
        out = out.withColumn("_salt", F.coalesce(salt, F.lit(0)))
        match = (F.col(key) == F.col("_k")) & (F.col("_salt") == F.col("_s"))
    else:
        match = F.col(key) == F.col("_k")
    out = out.join(keyed, match, how)
    return out.select(*[F.col(c) for c in big.columns], *[F.col(f"_v{i}").alias(v) for i, v in enumerate(values)])


def with_values(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row.

    The optimizer puts the expression of a column in the place of each of its
    uses; within lambda functions it is then computed again for every
    element.  A generator of one row keeps values and uses apart, without
    leaving the stage.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def widened(df: DataFrame) -> DataFrame:
    """``df`` on all cores, where it is read from fewer files than there are cores.

    A small file is one task, however dear its rows.  Tables of many files are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def broadcast_if_small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """Marks a table for broadcast if it has at most ``most`` rows; otherwise the optimizer decides.

    ``df`` should be materialised, since its rows are counted.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bucket_pairs(df: DataFrame, key: str, block: int = 256, where: str = "true") -> DataFrame:
    """All unordered pairs of rows with the same ``key``, hot keys in blocks.

    Columns of ``df`` other than ``key`` come out twice, as ``x_a`` and
    ``x_b``; ``where`` is a condition on them.  A key with at most ``block``
    rows is paired within its group, which is a bounded array; a larger one
    is cut into ceil(n / block) blocks, and each pair of blocks is its own
    join key, so that no task holds more than two blocks of one key at a
    time.  Nothing is dropped.  ``df`` needs the column ``sid``; pairs have
    ``sid_a < sid_b``.
    """
    values = [c for c in df.columns if c != key]
    df = stored(df)
    # One shuffle by key serves the counts and the groups.
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    sizes = materialise(sizes)
    most = sizes.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
    item = F.struct(*values)
    small = df.join(sizes.where(F.col("_n") <= block).select(key), key).groupBy(key).agg(F.collect_list(item).alias("_g"))
    small = small.select("_g", F.explode("_g").alias("_a"))
    small = small.select("_a", F.explode(F.filter("_g", lambda x: x["sid"] > F.col("_a.sid"))).alias("_b"))
    out = small.select(*[F.col(f"_a.{c}").alias(f"{c}_a") for c in values], *[F.col(f"_b.{c}").alias(f"{c}_b") for c in values]).where(where)
    if most <= block:
        return out
    large = materialise(sizes.where(F.col("_n") > block).withColumn("_uses", F.col("_n")))
    m = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    blocked = lookup(df, large, key, "_uses", F.xxhash64("sid"), how="inner").withColumn("_m", m)
    blocked = blocked.withColumn("_b", F.pmod(F.xxhash64("sid", F.lit(11)), F.col("_m")).cast("int"))
    keyed = blocked.withColumn("_o", F.explode(F.expr("sequence(0, _m - 1)")))
    keyed = keyed.select("*", F.least("_b", "_o").alias("_lo"), F.greatest("_b", "_o").alias("_hi"))
    a = keyed.select(F.col(key), "_lo", "_hi", F.col("_b").alias("_ba"), *[F.col(c).alias(f"{c}_a") for c in values])
    b = keyed.select(F.col(key), "_lo", "_hi", F.col("_b").alias("_bb"), *[F.col(c).alias(f"{c}_b") for c in values])
    cut = a.join(b, [key, "_lo", "_hi"]).where("sid_a < sid_b and (_lo = _hi or _ba <> _bb)").where(where)
    return out.unionByName(cut.select(*[f"{c}_a" for c in values], *[f"{c}_b" for c in values]))

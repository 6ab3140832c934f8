"""Records of evaluation splits that stand, exactly or nearly, in train.

``found`` follows the plain rule of the problem (identical, copies, similar
word sets, look-alikes), since edit distance cannot see moved pieces and
words, and 40 % of other words is far beyond any usable number of edits.
``edit_pairs`` is the edit-distance segment join over the whole table: an
evaluation string is cut into k + 1 segments, of which one must stand
unchanged in any string within k edits, near its old place; training
substrings are matched at the allowed places and verified by banded dynamic
programming.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import blank, expand, ordered, rows_of
from quern.llm.near import FREQUENT, keyed_rows, similar_sets, units_of
from quern.runtime import bucket_pairs, lookup, materialise

TRAIN, EVAL = ("train",), ("val", "test")


def alike_units(sets: DataFrame, units: DataFrame, threshold: float, frequent: int) -> DataFrame:
    """``u, v``: units that are copies, look-alikes, near-duplicates or one
    and the same, of which ``u`` has train rows and ``v`` evaluation rows.

    ``f0`` and ``f1`` of units and sets tell whether they have such rows;
    pairs that cannot cross the splits go before anything is compared.
    """
    across = "f0_a and f1_b or f1_a and f0_b"
    members = units.select(F.col("sid").alias("u"), F.col("unit").alias("id"), "f0", "f1")
    pairs = expand(similar_sets(sets, threshold, frequent, where=across).toDF("u", "v"), members).where(across)
    pairs = pairs.withColumnsRenamed({"id_a": "sid_a", "id_b": "sid_b"})
    worded = units.join(sets.where(F.size("words") > 0).select("sid"), "sid", "left_semi")
    for keyed, key in ((worded.withColumnRenamed("sid", "set"), "set"), (units, "copy"), (units, "form")):
        pairs = pairs.unionByName(bucket_pairs(keyed.select(key, F.col("unit").alias("sid"), "f0", "f1"), key, where=across).select(*pairs.columns))
    ways = [F.struct(F.col(f"sid_{x}").alias("u"), F.col(f"sid_{y}").alias("v"), (F.col(f"f0_{x}") & F.col(f"f1_{y}")).alias("ok")) for x, y in ("ab", "ba")]
    both = pairs.select(F.explode(F.array(*ways)).alias("_w")).where("_w.ok").select("_w.u", "_w.v")
    own = units.where("f0 and f1").select(F.col("unit").alias("u"), F.col("unit").alias("v"))
    return materialise(both.unionByName(own).distinct())


def overlaps(df: DataFrame, id_col: str, text_col: str, split_col: str, threshold: float = 0.6, frequent: int = FREQUENT, **more: str) -> DataFrame:
    """``id_a`` (train), ``id_b`` (evaluation), ``split_b`` and the columns of ``more`` as ``x_a``, ``x_b``."""
    rows = rows_of(df, id_col, text_col, split=split_col, **more)
    rows = rows.where(~blank(F.col("text")) & F.col("split").isin(*TRAIN, *EVAL))
    keyed = keyed_rows(rows)
    units, sets = units_of(keyed, F.bool_or(F.col("split").isin(*TRAIN)), F.bool_or(F.col("split").isin(*EVAL)))
    pairs = alike_units(sets, units, threshold, frequent)
    members = keyed.select(F.col("unit").alias("u"), "id", "split", *more)
    train, held = (members.where(F.col("split").isin(*x)) for x in (TRAIN, EVAL))
    return expand(pairs, train, held)


def found(df: DataFrame, id_col: str = "id", text_col: str = "sentence", split_col: str = "data_split") -> DataFrame:
    """``id_a, id_b`` (id_a < id_b): a train row and a val or test row alike.

    Rows with null or blank text, or with a null or other split, have no
    pairs.  A row that is there twice counts once.
    """
    return ordered(overlaps(df, id_col, text_col, split_col).select("id_a", "id_b"))


def report(df: DataFrame, id_col: str = "id", text_col: str = "sentence", split_col: str = "data_split", source_col: str = "source") -> DataFrame:
    """Per split and source of the evaluation row: ``split, source, n_rows``
    (evaluation rows seen in train), ``n_train`` (train rows they are like)
    and ``n_pairs``.  A null source is a group of its own."""
    pairs = overlaps(df, id_col, text_col, split_col, source=source_col)
    # Per evaluation row first, so that no group holds its pairs at once.
    each = pairs.groupBy("id_b", "split_b", "source_b").agg(F.count(F.lit(1)).alias("n"))
    trains = pairs.select("split_b", "source_b", "id_a").distinct().groupBy("split_b", "source_b").agg(F.count(F.lit(1)).alias("n_train"))
    out = each.groupBy("split_b", "source_b").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_pairs"))
    out = out.alias("o").join(trains.alias("t"), (F.col("o.split_b") == F.col("t.split_b")) & F.col("o.source_b").eqNullSafe(F.col("t.source_b")))
    return out.select(F.col("o.split_b").alias("split"), F.col("o.source_b").alias("source"), "n_rows", "n_train", "n_pairs")


# -- edit-distance segment join ------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _segments(n: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of the k + 1 even segments of a string of n characters."""
    short, longer = n // (k + 1), n % (k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = short + (i >= k + 1 - longer)
        out.append((at, size))
        at += size
    return out


def _rolling(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes and powers modulo 2**64: any substring's hash in O(1)."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    powers = np.empty(len(codes) + 1, np.uint64)
    powers[0] = 1
    powers[1:] = np.cumprod(np.full(len(codes), _BASE, np.uint64))
    # sum of code * BASE**i; a window is compared after it is scaled to a common power.
    prefix = np.concatenate([[np.uint64(0)], np.cumsum((codes + np.uint64(1)) * powers[:-1])])
    return prefix, powers


def _inverse_powers(n: int) -> np.ndarray:
    inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = np.empty(n + 1, np.uint64)
    out[0] = 1
    out[1:] = np.cumprod(np.full(n, inv, np.uint64))
    return out


def _plan(n: int, k: int, held: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and tags (length of the evaluation string, number of the
    segment) of all substrings of a text of n characters that are looked up."""
    starts, sizes, tags = [], [], []
    for length in [n] if held else range(max(k + 1, n - k), n + k + 1):
        for i, (at, size) in enumerate(_segments(length, k)):
            lo = hi = at
            if not held:
                # Multi-match-aware: at most i edits before, and k - i after the segment.
                shift = n - length
                lo = max(0, at - i, at + shift - (k - i))
                hi = min(n - size, at + i, at + shift + (k - i))
            starts += range(lo, hi + 1)
            sizes += [size] * max(0, hi - lo + 1)
            tags += [(length * 64 + i) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1] * max(0, hi - lo + 1)
    return np.array(starts, np.int64), np.array(sizes, np.int64), np.array(tags, np.uint64)


def _signs(k: int, held: bool):  # noqa: ANN202
    """UDF: segment keys of an evaluation string, or of all substrings of a
    training string where a segment of some length within k may stand."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        plans: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        with np.errstate(over="ignore"):
            for texts in batches:
                out = []
                for text in texts:
                    n = len(text)
                    if n not in plans:
                        if len(plans) > 2000:
                            plans.clear()
                        plans[n] = _plan(n, k, held)
                    starts, sizes, tags = plans[n]
                    prefix, _ = _rolling(text)
                    x = (prefix[starts + sizes] - prefix[starts]) * _inverse_powers(n)[starts] ^ tags
                    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                    out.append(np.unique((x ^ (x >> np.uint64(29))).view(np.int64)))
                yield pd.Series(out)

    return sign


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bitmap(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """256 bits that tell which hashed character pairs a text has."""
    for texts in batches:
        out = []
        for text in texts:
            codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            bits = np.zeros(256, np.uint8)
            with np.errstate(over="ignore"):
                bits[((codes[:-1] * np.uint64(1_000_003) + codes[1:]) * _BASE >> np.uint64(56)).astype(np.int64)] = 1
            out.append(np.packbits(bits).view(np.int64))
        yield pd.Series(out)


def _pair_bound(k: int) -> Column:
    """An edit removes and adds at most two character pairs each, so texts
    within k edits differ in at most 4 k of the bits."""
    differ = [F.bit_count(F.get(F.col("_xa"), F.lit(i)).bitwiseXOR(F.get(F.col("_xb"), F.lit(i)))) for i in range(4)]
    return differ[0] + differ[1] + differ[2] + differ[3] <= 4 * k


def bounded_distance(a: str, b: str, k: int) -> int:
    """Edit distance if at most k, else k + 1; banded dynamic programming."""
    if abs(len(a) - len(b)) > k:
        return k + 1
    # Common ends cost nothing.
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    at = 0
    while at < min(len(a), len(b)) and a[at] == b[at]:
        at += 1
    a, b = a[at:], b[at:]
    if not a or not b:
        return min(len(a) + len(b), k + 1)
    far = k + 1
    last = [j if j <= k else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - k), min(len(b), i + k)
        row = [far] * (len(b) + 1)
        if i <= k:
            row[0] = i
        best = row[0]
        for j in range(lo, hi + 1):
            v = last[j - 1] if x == b[j - 1] else 1 + min(last[j - 1], last[j], row[j - 1])
            row[j] = v if v < far else far
            best = min(best, row[j])
        if best > k:
            return far
        last = row
    return min(last[len(b)], far)


def _distance(k: int):  # noqa: ANN202
    @F.pandas_udf(T.IntegerType())
    def distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([bounded_distance(x, y, k) for x, y in zip(a, b)], dtype="int32")

    return distance


def edit_pairs(df: DataFrame, id_col: str = "id", text_col: str = "sentence", split_col: str = "data_split", k: int = 6) -> DataFrame:
    """``kind, id_a, id_b, distance``: strings of train and evaluation rows within k edits.

    ``pair``: the string of ``id_a`` (train) and that of ``id_b`` (evaluation)
    are ``distance`` edits apart; each is the smallest row with that string on
    its side; identical strings have distance 0.  ``member``: ``id_b`` has the
    same string on the same side as ``id_a``, so no row's links are lost and
    copies are not expanded into all pairs.  Strings of at most k characters,
    which have no whole segments, are compared with all strings of at most
    2 k characters, in blocks.  Null and blank strings and other splits have
    no pairs.
    """
    rows = rows_of(df, id_col, text_col, split=split_col)
    rows = rows.where(~blank(F.col("text")) & F.col("split").isin(*TRAIN, *EVAL))
    sides = rows.groupBy("text", F.col("split").isin(*EVAL).alias("held")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    sides = materialise(sides)
    train, held = sides.where("not held").select("id", "text"), sides.where("held").select("id", "text")
    fit = F.length("text") > k
    a = train.where(fit).select(F.col("id").alias("train_id"), F.explode(_signs(k, False)("text")).alias("key"))
    b = held.where(fit).select(F.col("id").alias("eval_id"), F.explode(_signs(k, True)("text")).alias("key"))
    maps = [materialise(x.select("id", _bitmap("text").alias("x"))) for x in (train, held)]
    pairs = _blocked(a, b, maps[0].toDF("train_id", "_xa"), maps[1].toDF("eval_id", "_xb"), _pair_bound(k))
    short = F.length("text") <= 2 * k
    # Short strings meet by the length of the evaluation string, in the same blocks; one of a pair has at most k characters.
    size = F.length("text")
    key = lambda n, tiny: F.struct(n.cast("bigint").alias("n"), tiny.alias("tiny"))
    tiny_b = held.where(short).select(F.col("id").alias("eval_id"), F.explode(F.when(size <= k, F.array(key(size, F.lit(True)), key(size, F.lit(False)))).otherwise(F.array(key(size, F.lit(False))))).alias("key"))
    steps = F.sequence(F.greatest(F.lit(1), size - k), F.least(size + k, F.lit(2 * k)))
    # A short training string meets every length; a longer one the evaluation strings of at most k characters.
    tiny_a = train.where(short).select(F.col("id").alias("train_id"), F.explode(F.transform(steps, lambda n: key(n, size > k))).alias("key"))
    tiny = _blocked(tiny_a, tiny_b, maps[0].toDF("train_id", "_xa"), maps[1].toDF("eval_id", "_xb"), _pair_bound(k))
    pairs = materialise(pairs.unionByName(tiny).distinct())
    for side, name, x, other in ((train, "train_id", "_a", "eval_id"), (held, "eval_id", "_b", "train_id")):
        uses = pairs.groupBy(name).agg(F.count(F.lit(1)).alias("uses"))
        table = side.select(F.col("id").alias(name), F.col("text").alias(x)).join(uses, name)
        pairs = lookup(pairs, table, name, "uses", F.xxhash64(other), how="inner")
    measured = materialise(pairs.select(F.lit("pair").alias("kind"), F.col("train_id").alias("id_a"), F.col("eval_id").alias("id_b"), _distance(k)("_a", "_b").alias("distance")))
    own = sides.select(F.struct("text", "held").alias("key"), F.col("id").alias("id_a"), "n").where("n > 1")
    copies = rows.select("id", F.struct("text", F.col("split").isin(*EVAL).alias("held")).alias("key"))
    members = lookup(copies, own, "key", "n", F.xxhash64("id"), how="inner").where("id <> id_a")
    members = members.select(F.lit("member").alias("kind"), "id_a", F.col("id").alias("id_b"), F.lit(0).alias("distance")).distinct()
    return measured.where(F.col("distance") <= k).unionByName(members)


def _blocked(a: DataFrame, b: DataFrame, maps_a: DataFrame, maps_b: DataFrame, bound: Column, block: int = 512) -> DataFrame:
    """Joins two key tables; a key that is frequent on both sides is joined in
    blocks, and pairs beyond ``bound`` go in the join itself."""
    size_b = materialise(b.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("_mb"), F.count(F.lit(1)).alias("_nb")))
    # Few of the many training keys are those of a segment; only they are kept.  The other side has each key once,
    # so rows of one key pass by one after another, and the adaptive plan splits the partition of a hot one.
    live = materialise(a.join(size_b.select("key", "_mb"), "key"))
    size_a = live.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("_ma"), F.first("_mb").alias("_mb"), F.count(F.lit(1)).alias("_na"))
    size_a = materialise(size_a.join(size_b.select("key", "_nb"), "key"))
    left = lookup(live.select("key", "train_id"), size_a.select("key", "_ma", "_mb", "_na"), "key", "_na", F.xxhash64("train_id"), how="inner")
    left = left.withColumn("_ba", F.pmod(F.xxhash64("train_id"), F.col("_ma")).cast("int"))
    left = left.join(maps_a, "train_id").withColumn("_bb", F.explode(F.expr("sequence(0, _mb - 1)"))).select("key", "_ba", "_bb", "train_id", "_xa")
    right = lookup(b, size_a.select("key", "_ma", "_mb", "_nb"), "key", "_nb", F.xxhash64("eval_id"), how="inner")
    right = right.withColumn("_bb", F.pmod(F.xxhash64("eval_id"), F.col("_mb")).cast("int"))
    right = right.join(maps_b, "eval_id").withColumn("_ba", F.explode(F.expr("sequence(0, _ma - 1)"))).select("key", "_ba", "_bb", "eval_id", "_xb")
    return left.join(right, ["key", "_ba", "_bb"]).where(bound).select("train_id", "eval_id").distinct()

"""Near-duplicates by word-set similarity, with PartEnum signatures.

PartEnum cuts the feature domain into parts, and gives every set one
signature for each subset of parts that must agree in at least one case if
two sets of a band of sizes are similar; similar sets then share a signature.

Parts that are cut by hash do not work for a similarity as low as 0.6: a pair
may differ in half of its words, so the subsets that are sure to agree are
mostly empty or hold common words only.  Here the domain is cut in the order
of frequency: the rarest word comes first, and every word is a part by itself.

* Sizes lie in bands that grow by 1 / t, so similar sets lie in one band or
  in neighbouring ones.  Each pair of bands is a tag of its own.
* Two sets of sizes a and b with Jaccard similarity of at least t agree in at
  least ``c = ceil(t / (1 + t) * (a + b))`` parts.  Of those the ``g`` rarest
  lie among the first ``a - c + g`` parts of the one and the first
  ``b - c + g`` of the other: c - g shared parts must still follow.
* So a set has a signature for each ``g``-subset of its first ``a - c + g``
  parts, where c is the least for its size and the other band.

Every similar pair shares a signature, whatever the data; candidates are
compared on their words.  Overfull buckets are joined in blocks, never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, count
from math import ceil, floor, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import blank, expand, key128, letters, ordered, rows_of, word_list
from quern.llm.lookalike import row_forms
from quern.runtime import bucket_pairs, lookup, materialise

#: Parts in a signature.
SUBSET = 2
#: At most so many words are known by their frequency (any word with more than
#: this share of all occurrences is); the order of the others is that of a hash.
FREQUENT = 2_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def band(size: int, t: float) -> int:
    """The band of a size; bands grow by 1 / t."""
    return floor(log(size) / -log(t) + 1e-9)


def overlap(a: int, b: int, t: float) -> int:
    """The least number of shared elements of similar sets of these sizes."""
    return ceil(t / (1 + t) * (a + b) - 1e-9)


@lru_cache(maxsize=4096)
def plan(size: int, t: float) -> tuple[tuple[int, int, int], ...]:
    """``tag, g, prefix`` of a set of that size: which subsets of which parts it enumerates."""
    out = []
    for other in range(band(max(1, ceil(t * size - 1e-9)), t), band(floor(size / t + 1e-9), t) + 1):
        own = band(size, t)
        sizes = [x for x in range(max(1, ceil(t * size - 1e-9)), floor(size / t + 1e-9) + 1) if band(x, t) == other]
        least = min((overlap(size, x, t) for x in sizes), default=0)
        if least:
            lo, hi = min(own, other), max(own, other)
            # Both sides must enumerate subsets of one size: as the smallest sets of the two bands allow.
            first = lambda i: next(x for x in count(max(1, floor(t**-i) - 1)) if band(x, t) >= i)
            g = min(SUBSET, max(1, overlap(first(lo), first(hi), t)))
            out.append((lo * 1_000_003 + hi, g, min(size, size - least + g)))
    return tuple(out)


@lru_cache(maxsize=4096)
def _subsets(prefix: int, g: int) -> np.ndarray:
    return np.array(list(combinations(range(prefix), g)), np.int64).reshape(-1, g).T


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def signatures(sets: list[np.ndarray], t: float, frequent: np.ndarray) -> list[np.ndarray]:
    """Signed 64-bit signatures of sets of hashed words (``int64``).

    ``frequent``: the hashes of the frequent words, the most frequent last.
    """
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sets)
    order = np.argsort(frequent, kind="stable")
    known = frequent[order]
    sizes = np.fromiter((len(x) for x in sets), np.int64, len(sets))
    with np.errstate(over="ignore"):
        for size in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == size)
            words = np.stack([sets[i] for i in at])
            if len(known):
                near = np.minimum(np.searchsorted(known, words), len(known) - 1)
                rank = np.where(known[near] == words, order[near] + 1, 0)
            else:
                rank = np.zeros(words.shape, np.int64)
            words = np.take_along_axis(words, np.lexsort((words, rank), axis=-1), axis=-1).view(np.uint64)
            signed = []
            for tag, g, prefix in plan(int(size), t):
                total = np.full((len(at), 1), _mix(np.array([tag + 1], np.uint64))[0], np.uint64)
                for places in _subsets(prefix, g):
                    total = _mix(total * _M1 + words[:, places])
                signed.append(total)
            if signed:
                both = np.concatenate(signed, axis=1).view(np.int64)
                for i, row in zip(at, both):
                    out[i] = row
    return out


def _signed(t: float, frequent: list[int]):  # noqa: ANN202
    known = np.array(frequent, np.int64)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sets in batches:
            yield pd.Series(signatures([np.asarray(x, np.int64) for x in sets], t, known))

    return sign


def word_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with ``wid``, the key of the distinct words of ``text``, and ``words``, their sorted 64-bit hashes."""
    rows = rows.withColumn("_w", F.array_sort(F.array_distinct(word_list(F.col("text")))))
    rows = rows.withColumn("wid", key128(F.array_join("_w", " ")))
    return rows.withColumn("words", F.array_sort(F.transform("_w", lambda w: F.xxhash64(w)))).drop("_w")


def _bits(words: Column) -> Column:
    """64 bits that tell which hashed words a set has."""
    one = F.lit(1).cast("bigint")
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda acc, w: acc.bitwiseOR(F.call_function("shiftleft", one, F.pmod(w, F.lit(64)).cast("int"))))


def similar_sets(sets: DataFrame, threshold: float = 0.6, frequent: int = FREQUENT, where: str = "true") -> DataFrame:
    """``sid_a, sid_b`` of all pairs of sets with Jaccard >= ``threshold``.

    ``sets``: ``sid``, ``words`` (distinct 64-bit hashes) and columns on which
    ``where`` is a condition, as ``x_a`` and ``x_b``; equal sets should be one
    row.  Empty sets have no pairs.  Exact: see the module's text.
    """
    sets = sets.where(F.size("words") > 0)
    more = [c for c in sets.columns if c not in ("sid", "words")]
    uses = sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    total = sets.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    # Fewer than ``frequent`` words can have more than that share of all occurrences.
    known = [r["word"] for r in uses.where(F.col("df") * F.lit(frequent) > F.lit(total)).orderBy("df", "word").collect()]
    signed = sets.select("sid", F.size("words").alias("size"), _bits(F.col("words")).alias("bits"), *more, _signed(threshold, known)("words").alias("sigs"))
    signed = signed.select(F.explode("sigs").alias("sig"), "sid", "size", "bits", *more)
    # Sets of a and b words with an overlap of c differ in a + b - 2 c of them, and in no more of the bits.
    t = F.lit(threshold)
    differ = F.col("size_a") + F.col("size_b") - 2 * F.ceil(t / (1 + t) * (F.col("size_a") + F.col("size_b")) - 1e-9)
    close = (F.col("size_a") >= t * F.col("size_b") - 1e-9) & (F.col("size_b") >= t * F.col("size_a") - 1e-9)
    close &= F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= differ
    pairs = bucket_pairs(signed, "sig", where=where).where(close).select("sid_a", "sid_b").distinct()
    return verified(materialise(pairs), sets, threshold)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of ``sid_a, sid_b`` with Jaccard >= ``threshold``; a set in very many pairs is spread."""
    for x, other in (("a", "b"), ("b", "a")):
        uses = pairs.groupBy(F.col(f"sid_{x}").alias("sid")).agg(F.count(F.lit(1)).alias("uses"))
        table = sets.select("sid", F.col("words").alias(f"_{x}")).join(uses, "sid").withColumnRenamed("sid", f"sid_{x}")
        pairs = lookup(pairs, table, f"sid_{x}", "uses", F.xxhash64(f"sid_{other}"), how="inner")
    shared = F.size(F.array_intersect("_a", "_b"))
    return pairs.where(shared >= F.lit(threshold - 1e-9) * (F.size("_a") + F.size("_b") - shared)).select("sid_a", "sid_b")


def keyed_rows(rows: DataFrame) -> DataFrame:
    """``id, unit, wid, copy, form, words`` and the other columns of ``rows``, materialised.

    ``wid`` (words), ``copy`` (pieces) and ``form`` (consistent form) are 128-bit keys
    of what must be equal, ``unit`` of all three together, so that no table of
    numbers is needed; ``words`` are the hashed words.
    """
    more = [c for c in rows.columns if c not in ("id", "text")]
    pieces = F.array_sort(F.filter(F.transform(F.split("text", "[,;]"), letters), lambda x: x != ""))
    keyed = word_keys(row_forms(rows)).select("id", *more, "wid", key128(F.array_join(pieces, " ")).alias("copy"), key128(F.col("form")).alias("form"), "words")
    return materialise(keyed.select("id", key128(F.concat("wid", "copy", "form")).alias("unit"), "wid", "copy", "form", "words", *more))


def units_of(keyed: DataFrame, *flags: Column) -> tuple[DataFrame, DataFrame]:
    """``unit, sid, copy, form`` and ``sid, words`` of keyed rows, with ``flags``: aggregates of rows that both get.

    ``sid`` is the smallest row with a set of words.
    """
    names = [f"f{i}" for i in range(len(flags))]
    per = [f.alias(n) for f, n in zip(flags, names)]
    units = materialise(keyed.groupBy("unit", "wid", "copy", "form").agg(F.min("id").alias("first"), F.any_value("words").alias("words"), *per))
    all_ = [F.bool_or(n).alias(n) for n in names]
    sets = materialise(units.groupBy("wid").agg(F.min("first").alias("sid"), F.any_value("words").alias("words"), F.count(F.lit(1)).alias("n_units"), *all_))
    units = lookup(units.select("unit", "wid", "copy", "form", *names), sets.select("wid", "sid", "n_units"), "wid", "n_units", F.xxhash64("unit"), how="inner")
    return materialise(units.drop("wid")), sets.select("sid", "words", *names)


def found(df: DataFrame, id_col: str = "id", text_col: str = "sentence", threshold: float = 0.6, frequent: int = FREQUENT) -> DataFrame:
    """``id_a, id_b``: all pairs of rows with word-set Jaccard >= ``threshold``
    that are neither copies (``copies``) nor look-alikes (``lookalike``).

    Null and blank texts, and texts without a word, have no pairs.  Rows that
    are there twice count once.
    """
    rows = rows_of(df, id_col, text_col).where(~blank(F.col("text")))
    keyed = keyed_rows(rows)
    units, sets = units_of(keyed)
    differ = "copy_a <> copy_b and form_a <> form_b"
    members = units.select(F.col("sid").alias("u"), F.col("unit").alias("id"), "copy", "form")
    across = expand(similar_sets(sets, threshold, frequent).toDF("u", "v"), members).where(differ).select("id_a", "id_b")
    worded = units.join(sets.where(F.size("words") > 0).select("sid"), "sid", "left_semi")
    within = bucket_pairs(worded.select(F.col("sid").alias("set"), F.col("unit").alias("sid"), "copy", "form"), "set", where=differ)
    pairs = across.unionByName(within.select(F.col("sid_a").alias("id_a"), F.col("sid_b").alias("id_b")))
    return ordered(expand(materialise(pairs.toDF("u", "v")), keyed.select(F.col("unit").alias("u"), "id")))


def groups(df: DataFrame, id_col: str = "id", text_col: str = "sentence", threshold: float = 0.6, frequent: int = FREQUENT) -> DataFrame:
    """``id, class_id, n_links``: a row for every non-blank row.

    A class is the set of rows with one set of words; ``class_id`` is its
    smallest id and ``n_links`` the number of other classes it is similar to.
    """
    rows = rows_of(df, id_col, text_col).where(~blank(F.col("text")))
    texts = materialise(word_keys(rows).select("id", "wid", "words"))
    sets = materialise(texts.groupBy("wid").agg(F.min("id").alias("sid"), F.any_value("words").alias("words"), F.count(F.lit(1)).alias("n")))
    pairs = similar_sets(sets.select("sid", "words"), threshold, frequent)
    links = pairs.select(F.explode(F.array("sid_a", "sid_b")).alias("sid")).groupBy("sid").agg(F.count(F.lit(1)).alias("links"))
    classes = sets.join(links, "sid", "left").select("wid", "n", F.col("sid").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"))
    return lookup(texts.select("id", "wid"), classes, "wid", "n", F.xxhash64("id")).select("id", "class_id", "n_links")

"""Free-typed names mapped to a reference list by prefix-filter similarity joins.

One join, ``similar``, used twice: the elements of a set are ordered by global
rarity, only rare prefixes are joined, length and positional filters follow,
and Jaccard is verified exactly.

* words to listed words, as sets of letters and letter pairs; what is left
  is judged by its kind of slip (plural, abbreviation, up to two edits).  All
  good readings of a word are kept.
* names to entries, as sets of listed words.  An entry must have all words of
  its food and qualifier among the readings; the best entry is kept (how well
  those words read, then Jaccard), none gives -1.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import blank, rows_of
from quern.runtime import lookup, materialise

#: Least Jaccard similarity of the letter sets of a typed and a listed word.
WORD_JACCARD = 0.3
#: Least Jaccard similarity of the listed words that a name may read as and those of an entry;
#: low, since a misspelt word has several readings that count as words here.
NAME_JACCARD = 0.15

# Other names of foods, the default of the table of aliases; fixed values.
ALIASES = {
    "aubergine": "eggplant", "beetroot": "beet", "calamari": "squid", "capsicum": "paprika", "coriander": "cilantro", "courgette": "zucchini",
    "filbert": "hazelnuts", "garbanzo": "chickpeas", "groundnut": "peanuts", "pawpaw": "papaya", "polenta": "cornmeal", "prawn": "shrimp",
    "rocket": "arugula", "soya": "soybeans", "yoghurt": "yogurt",
}


def alias_table(spark: SparkSession, aliases: dict[str, str] | None = None) -> DataFrame:
    """``other, canon``: another name and the listed word that it stands for."""
    return spark.createDataFrame(sorted((ALIASES if aliases is None else aliases).items()), "other string, canon string")


def _set_of(c: str) -> str:
    """SQL: letters with their occurrence and padded letter pairs of a word, as a set."""
    letters = f"filter(transform(split({c}, ''), (x, i) -> concat(x, size(filter(slice(split({c}, ''), 1, i), y -> y = x)))), x -> length(x) > 1)"
    padded = f"concat('<', {c}, '>')"
    pairs = f"transform(sequence(1, length({c}) + 1), i -> concat('_', substring({padded}, i, 2)))"
    return f"array_distinct(concat({letters}, {pairs}))"


def similar(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``a, b, jaccard`` of all pairs of sets with at least that similarity.

    ``left``: ``a`` (its id) and ``els`` (distinct elements); ``right``: ``b``
    and ``els``; ids are distinct.  Elements are ordered by their frequency in
    ``right``, the rarest first; those that ``right`` does not have come before
    all, as they can meet nothing.  An element that very many sets have is
    spread over tasks.  Empty sets have no pairs.
    """
    rank = right.select(F.explode("els").alias("el")).groupBy("el").agg(F.count(F.lit(1)).alias("df"))
    rank = materialise(rank)

    def ordered(df: DataFrame, name: str) -> DataFrame:
        long = df.select(name, F.size("els").alias("size"), F.explode("els").alias("el"))
        uses = long.groupBy("el").agg(F.count(F.lit(1)).alias("uses")).join(rank, "el")
        long = lookup(long, uses, "el", "uses", F.xxhash64(name))
        kept = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "el")))
        return long.groupBy(name, "size").agg(F.transform(kept, lambda x: x["el"]).alias("els"))

    def prefixed(df: DataFrame, name: str, x: str) -> DataFrame:
        keep = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1
        long = df.select(name, F.col("size").alias(f"n{x}"), F.posexplode(F.slice("els", F.lit(1), keep.cast("int"))).alias(f"p{x}", "el"))
        return long.select("el", name, f"n{x}", f"p{x}")

    a, b = materialise(ordered(left, "a")), materialise(ordered(right, "b"))
    x = prefixed(a, "a", "a")
    # The sets of ``right`` with an element in their prefix, cut into arrays.
    held = prefixed(b, "b", "b").withColumn("part", F.pmod(F.xxhash64("b"), F.lit(16)))
    held = held.groupBy("el", "part").agg(F.collect_list(F.struct("b", "nb", "pb")).alias("sets")).groupBy("el").agg(F.collect_list("sets").alias("parts"))
    uses = x.groupBy("el").agg(F.count(F.lit(1)).alias("uses"))
    met = lookup(x, held.join(uses, "el"), "el", "uses", F.xxhash64("a"), how="inner").select("a", "na", "pa", F.explode("parts").alias("sets"))
    met = met.select("a", "na", "pa", F.explode("sets").alias("_s")).select("a", "na", "pa", "_s.*")
    t = F.lit(threshold)
    length = (F.col("nb") >= t * F.col("na") - 1e-9) & (F.col("na") >= t * F.col("nb") - 1e-9)
    # What is left from this place on must still reach the overlap needed.
    need = F.ceil(t / (1 + t) * (F.col("na") + F.col("nb")) - 1e-9)
    first = met.where(length).groupBy("a", "b", "na", "nb").agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    first = materialise(first.where(F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need).select("a", "b"))
    uses = first.groupBy("b").agg(F.count(F.lit(1)).alias("uses"))
    both = lookup(first, b.select("b", F.col("els").alias("_b")).join(uses, "b"), "b", "uses", F.xxhash64("a"), how="inner")
    both = both.join(a.select("a", F.col("els").alias("_a")), "a")
    shared = F.size(F.array_intersect("_a", "_b"))
    return both.withColumn("jaccard", shared / (F.size("_a") + F.size("_b") - shared)).where(F.col("jaccard") >= threshold - 1e-9).select("a", "b", "jaccard")


def similar_words(typed: DataFrame, listed: DataFrame, threshold: float = WORD_JACCARD) -> DataFrame:
    """``word, other, jaccard`` of all pairs with that similarity of their letter sets.

    ``typed``: ``word``; ``listed``: ``other``; both distinct.
    """
    left = typed.select(F.col("word").alias("a"), F.expr(_set_of("word")).alias("els"))
    right = listed.select(F.col("other").alias("b"), F.expr(_set_of("other")).alias("els"))
    return similar(left, right, threshold).toDF("word", "other", "jaccard")


def _edits(a: str, b: str, most: int = 2) -> int:
    """Edits incl. swaps of neighbours (optimal string alignment), ``most + 1`` if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    if min(len(a), len(b)) > 2 * most + 2 and not set(a[:3]) & set(b[:3]):
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(row[-1] + 1, one[j] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def _stem(w: str) -> str:
    for end, to in (("ies", "y"), ("oes", "o"), ("es", "e"), ("s", "")):
        if w.endswith(end) and len(w) > len(end) + 2:
            return w[: -len(end)] + to
    return w


def _plurals(w: str) -> list[str]:
    return [w + "s", w + "es", w[:-1] + "ies"] if w[-1:] != "s" else [w]


def slip(word: str, other: str) -> float:
    """How well ``word`` reads as ``other``: 1 the same, 0 not at all."""
    if word == other:
        return 1.0
    plain, base = _stem(word), _stem(other)
    if plain == base or plain == other or word == base or word == other + "es":
        return 0.97
    if word[0] == other[0] and len(word) >= 3:
        bare = other[0] + "".join(c for c in other[1:] if c not in "aeiou")
        if word == bare:
            return 0.93
        if len(word) < len(other) - 1 and other.startswith(word):
            return 0.9
    short = min(len(plain), len(base))
    # Each letter that is missing altogether takes an edit, in all of the pairs below.
    if min(len(set(other) - set(word)), len(set(base) - set(plain))) > 2:
        return 0.0
    edits = 3
    for x, y in {(word, other), (plain, base), *((word, x) for x in _plurals(other))}:
        edits = min(edits, _edits(x, y))
        if edits < 2:
            break
    if edits == 1 and short >= 3:
        return 0.88 if short > 4 else 0.75
    if edits == 2 and short >= 6:
        return 0.7
    return 0.0


@F.pandas_udf(T.DoubleType())
def _slip(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([slip(x, y) for x, y in zip(a, b)])


def entry_words(catalogue: DataFrame, id_col: str = "fdc_id", text_col: str = "description") -> DataFrame:
    """``entry, els, need`` of ``Food, qualifier[, state]`` or ``Food (qualifier)[, state]``: all
    distinct words, and those of food and qualifier, of which each may have several."""
    rows = rows_of(catalogue, id_col, text_col).where(~blank(F.col("text")))
    part = F.split(F.regexp_replace(F.lower("text"), r"\s*\(([^)]*)\)", ", $1"), r"\s*,\s*")
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\p{L}+"), F.lit(0)))
    out = rows.select(F.col("id").alias("entry"), words(F.array_join(part, " ")).alias("els"), words(F.array_join(F.slice(part, 1, 2), " ")).alias("need"))
    return out.where(F.size("need") > 0)


def mapped(names: DataFrame, catalogue: DataFrame, id_col: str = "text_id", text_col: str = "text", order_col: str = "loaded_at", entry_col: str = "fdc_id", entry_text_col: str = "description", aliases: DataFrame | None = None) -> DataFrame:
    """``text_id, text, fdc_id, score``: one row per id with a non-blank text.

    ``fdc_id`` is -1 and ``score`` 0 where no entry is similar whose food and
    qualifier are both in the text.  ``aliases``: ``other, canon``, by default
    ``alias_table``.  Of rows delivered again under one id the latest by
    ``order_col`` counts.  Ties between entries go to the smaller id.  Null
    and blank texts have no row; an empty catalogue maps everything to -1.
    """
    rows = rows_of(names, id_col, text_col, at=order_col).where(~blank(F.col("text")))
    rows = materialise(rows.groupBy("id").agg(F.max_by("text", F.struct(F.coalesce("at", F.lit(0).cast("timestamp")), "text")).alias("text")))
    texts = materialise(rows.groupBy("text").agg(F.min("id").alias("sid"), F.count(F.lit(1)).alias("n")))
    word = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    long = texts.select("sid", F.explode(word).alias("word"))
    entries = materialise(entry_words(catalogue, entry_col, entry_text_col))
    spark = names.sparkSession
    listed = entries.select(F.explode("els").alias("canon")).distinct()
    alias = (alias_table(spark) if aliases is None else aliases.select("other", "canon")).join(listed, "canon", "left_semi")
    listed = materialise(listed.select(F.col("canon").alias("other"), "canon").unionByName(alias.select("other", "canon")).distinct())
    typed = materialise(long.groupBy("word").agg(F.count(F.lit(1)).alias("uses")))
    near = similar_words(typed.select("word"), listed.select("other").distinct())
    # Two edits and a plural change the length by at most four; an abbreviation is shorter and begins alike.
    short = (F.left("word", F.lit(1)) == F.left("other", F.lit(1))) & (F.length("word") < F.length("other"))
    near = near.where((F.abs(F.length("word") - F.length("other")) <= 4) | short)
    # Written before and after, so that each pair is judged once, and on all tasks.
    near = materialise(near.select("word", "other").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    near = materialise(near.withColumn("slip", _slip("word", "other")))
    readings = near.where("slip > 0").join(listed, "other").groupBy("word", "canon").agg(F.max("slip").alias("slip"))
    best = readings.groupBy("word").agg(F.collect_list(F.struct("canon", "slip")).alias("readings")).join(typed, "word")
    read = lookup(long, best, "word", "uses", F.xxhash64("sid"), how="inner").select("sid", F.explode("readings").alias("_r")).select("sid", "_r.*")
    read = materialise(read.groupBy("sid", "canon").agg(F.max("slip").alias("slip")).groupBy("sid").agg(F.map_from_entries(F.collect_list(F.struct("canon", "slip"))).alias("read")))
    # Names of the same listed words meet the same entries.
    sets = read.select(F.array_sort(F.map_keys("read")).alias("els")).groupBy("els").agg(F.count(F.lit(1)).alias("uses"))
    sets = materialise(sets.select(F.array_join("els", " ").alias("key"), "els", "uses"))
    hits = similar(sets.select(F.col("key").alias("a"), "els"), entries.select(F.col("entry").alias("b"), "els"), NAME_JACCARD)
    hits = hits.join(entries.select(F.col("entry").alias("b"), "need"), "b").join(sets.select(F.col("key").alias("a"), "els"), "a")
    hits = hits.where(F.size(F.array_intersect("need", "els")) == F.size("need"))
    hits = hits.groupBy("a").agg(F.collect_list(F.struct(F.col("b").alias("entry"), "need", "jaccard")).alias("hits")).join(sets.select(F.col("key").alias("a"), "uses"), "a")
    keyed = read.withColumn("key", F.array_join(F.array_sort(F.map_keys("read")), " "))
    top = lookup(keyed, hits.withColumnRenamed("a", "key"), "key", "uses", F.xxhash64("sid"), how="inner")
    slips = lambda h: F.aggregate(h["need"], F.lit(0.0), lambda acc, w: acc + F.element_at("read", w)) / F.size(h["need"])
    scored = F.transform("hits", lambda h: F.struct((2 * slips(h) + 0.2 * h["jaccard"]).alias("score"), (-h["entry"]).alias("less")))
    top = top.select("sid", F.array_max(scored).alias("_t")).select("sid", (-F.col("_t.less")).alias("entry"), "_t.score")
    known = texts.join(top, "sid", "left").select("text", "n", F.coalesce("entry", F.lit(-1)).cast("bigint").alias("fdc_id"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return lookup(rows, known, "text", "n", F.xxhash64("id")).select(F.col("id").alias("text_id"), "text", "fdc_id", "score")


def found(names: DataFrame, catalogue: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``text_id, fdc_id`` (-1: no entry)."""
    return mapped(names, catalogue, aliases=aliases).select("text_id", "fdc_id")


def unmatched(names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``text, n``: texts without an entry and how many ids have them."""
    return mapped(names, catalogue).where("fdc_id = -1").groupBy("text").agg(F.count(F.lit(1)).alias("n"))

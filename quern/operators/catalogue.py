"""The food catalogue: categories, one entry per description, similarity matching."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import vocab
from quern.functions.porter import stem as porter
from quern.runtime import materialise

# Data types in order of preference; fixed values.
PREFERENCE = ["foundation_food", "sr_legacy_food", "survey_fndds_food"]

# Substitutions of stemmed tokens; fixed values.
PHRASES = {
    ("doubl", "cream"): ["heavi", "cream"], ("glac", "cherri"): ["maraschino", "cherri"], ("ice", "sugar"): ["powder", "sugar"],
    ("mang", "tout"): ["snow", "pea"], ("plain", "flour"): ["all", "purpos", "flour"], ("singl", "cream"): ["light", "cream"],
    ("haa", "avocado"): ["hass", "avocado"],
}
TOKENS = {
    "aubergin": "eggplant", "beetroot": "beet", "capsicum": "bell", "chile": "chili", "chilli": "chili", "coriand": "cilantro",
    "cornflour": "cornstarch", "courgett": "zucchini", "gherkin": "pickl", "mangetout": "snowpea", "prawn": "shrimp", "rocket": "arugula",
    "swede": "rutabaga", "yoghurt": "yogurt",
}
TOKEN_PHRASES = {"lemongrass": ["lemon", "grass"], "low-sodium": ["low", "sodium"]}
# Stems that tell that a food is not raw, or that it is called so already; fixed values.
COOKED = [
    "age", "bake", "black", "blanch", "boil", "brais", "brew", "broil", "butter", "can", "cook", "crisp", "cultur", "cure", "decaffein",
    "dehydr", "devil", "distil", "dri", "ferment", "flavor", "fortifi", "fresh", "fri", "grill", "ground", "heat", "hull", "microwav",
    "parboil", "pasteur", "pickl", "poach", "precook", "prepar", "preserv", "powder", "reconstitut", "refin", "refri", "reheat", "rehydr",
    "render", "roast", "simmer", "smoke", "soak", "spice", "steam", "stew", "toast", "unbak", "unsalt", "raw",
]
# Entries for names of exactly these stems; fixed values.
OVERRIDES = [
    (["salt"], 746775), (["sea", "salt"], 746775), (["egg"], 748967), (["butter"], 789828), (["garlic"], 1104647), (["mayonnais"], 2710204),
    (["all", "purpos", "flour"], 790018),
]


def override_table(spark: SparkSession) -> DataFrame:
    """``tokens, fdc_id`` for ``match``."""
    return spark.createDataFrame(OVERRIDES, "tokens array<string>, fdc_id bigint")


def category_map(*tables: DataFrame) -> DataFrame:
    """``id, category`` of several ``id, category`` tables; a later table wins."""
    all_ = None
    for n, t in enumerate(tables):
        t = t.select(F.col("id"), F.col("category"), F.lit(n).alias("_n"))
        all_ = t if all_ is None else all_.unionByName(t)
    return all_.groupBy("id").agg(F.max_by("category", F.struct("_n", "category")).alias("category"))


def preferred_entries(foods: DataFrame, order: list[str] = PREFERENCE) -> DataFrame:
    """One row per description: the preferred data type, of one type the newest, then the smaller id.

    ``foods``: ``fdc_id, data_type, description, publication_date`` and others.
    """
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), F.col("data_type")), F.lit(0))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    best = F.min_by(F.struct(*foods.columns), F.struct(rank, -F.unix_date("publication_date"), F.col("fdc_id")))
    return foods.groupBy(F.col("description").alias("_d")).agg(best.alias("_b")).select("_b.*")


def content_tokens(tokens: Column, stems: Column) -> Column:
    """Stems of tokens that are no number, mark, space, stop word or single character."""
    pairs = F.arrays_zip(tokens.alias("t"), stems.alias("s"))
    dull = lambda t: t.rlike(r"^\p{N}+$|^\s*$") | F.lit(vocab.PUNCTUATION).contains(t) | t.isin(vocab.STOP_WORDS) | (F.length(t) <= 1)
    return F.transform(F.filter(pairs, lambda x: ~dull(x["t"])), lambda x: x["s"])


def normalise_spelling(tokens: Column) -> Column:
    """Substitutions from left to right: pairs, single tokens to phrases, single tokens."""
    low = F.transform(tokens, F.lower)
    nothing = F.array().cast("array<string>")

    def one(t: Column, nxt: Column) -> tuple[Column, Column]:
        pair = F.when(F.lit(False), nothing)
        for (a, b), to in PHRASES.items():
            pair = pair.when((t == a) & (nxt == b), F.array(*[F.lit(x) for x in to]))
        single = F.when(F.lit(False), nothing)
        for a, to in TOKEN_PHRASES.items():
            single = single.when(t == a, F.array(*[F.lit(x) for x in to]))
        for a, b in TOKENS.items():
            single = single.when(t == a, F.array(F.lit(b)))
        return pair, single.otherwise(F.array(t))

    start = F.struct(nothing.alias("out"), F.lit(False).alias("skip"))
    pairs = F.transform(low, lambda t, i: F.struct(t.alias("t"), F.coalesce(F.get(low, i + 1), F.lit("")).alias("n")))

    def step(state: Column, x: Column) -> Column:
        pair, single = one(x["t"], x["n"])
        added = F.when(state["skip"], nothing).otherwise(F.coalesce(pair, single))
        return F.struct(F.concat(state["out"], added).alias("out"), (~state["skip"] & pair.isNotNull()).alias("skip"))

    return F.aggregate(pairs, start, step)["out"]


# -- embeddings ----------------------------------------------------------------


def binarised(vec: Column) -> Column:
    """VNEG below the mean of the negative elements, VPOS above that of the positive ones, else V0."""
    mean = lambda keep: F.aggregate(F.filter(vec, keep), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n")), lambda a: F.try_divide(a["s"], a["n"]))
    low, high = mean(lambda x: x < 0), mean(lambda x: x > 0)
    return F.transform(vec, lambda x: F.when(x < low, "VNEG").when(x > high, "VPOS").otherwise("V0"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """Null if a vector is zero."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def token_similarity(a: Column, b: Column) -> Column:
    """1 for equal vectors, otherwise the logistic of the inverse distance; 0 if one is null."""
    d = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    return F.when(a.isNull() | b.isNull(), 0.0).when(d == 0, 1.0).otherwise(1 / (1 + F.exp(-1 / d)))


def token_probability(docs: DataFrame) -> DataFrame:
    """``token, n, p`` over ``id, tokens``."""
    counts = docs.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts)
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.select("token", "n", (F.col("n") / F.lit(total)).alias("p"))


def weight_factor(docs: DataFrame, probability: DataFrame) -> tuple[float | None, float]:
    """``a, min_p``: the factor of unsupervised smoothed inverse frequency and
    the least probability.  ``a`` is None if no token is more probable than chance."""
    v, min_p = probability.agg(F.count(F.lit(1)), F.min("p")).first()
    size = docs.agg(F.floor(F.avg(F.size("tokens")))).first()[0] or 0
    if not v:
        return None, 1.0
    limit = 1 - (1 - 1 / v) ** size
    alpha = probability.where(F.col("p") > limit).count() / v
    return ((1 - alpha) / (alpha * 0.5 * v) if alpha else None), min_p


def embed(docs: DataFrame, vectors: DataFrame, probability: DataFrame, factor: tuple[float | None, float]) -> DataFrame:
    """``id, vec``: the weighted mean of token vectors, each dimension normalised over the document's tokens.

    ``docs``: ``id, tokens``; ``vectors``: ``token, vec``.  A document without
    a known token gets the factor in every dimension.
    """
    a, min_p = F.lit(factor[0]).cast("double"), F.lit(factor[1])
    first = vectors.select(F.size("vec")).first()
    dim = first[0] if first else 0
    long = docs.select("id", F.posexplode("tokens").alias("at", "token")).join(vectors, "token")
    weighted = long.join(probability.select("token", "p"), "token", "left").withColumn("w", a / (0.5 * a + F.coalesce(F.col("p"), min_p)))
    cells = weighted.select("id", "w", F.posexplode("vec").alias("k", "x"))
    # Norm and weighted sum of a dimension come from the same pass.
    dims = cells.groupBy("id", "k").agg(F.sqrt(F.sum(F.col("x").cast("double") ** 2)).alias("norm"), F.sum(F.col("w") * F.col("x")).alias("s"), F.count(F.lit(1)).alias("n"))
    value = F.coalesce(F.try_divide("s", F.col("norm") * F.col("n")), F.lit(0.0))
    made = dims.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value.alias("v")))), lambda c: c["v"]).alias("vec"))
    return docs.select("id").join(made, "id", "left").select("id", F.coalesce(F.col("vec"), F.array_repeat(a, dim)).alias("vec"))


def nearest(queries: DataFrame, entries: DataFrame, n: int = 50, block: int = 2_000) -> DataFrame:
    """``qid, eid, distance, rank``: the n nearest entries of each query by cosine distance.

    A stated query set against all entries, in blocks: every entry meets every
    query block once, and a block keeps its n best before anything is
    shuffled.  Ties go to the smaller entry id.
    """
    blocks = max(1, -(-queries.count() // block))
    q = queries.select("qid", F.col("qvec"), F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("_b"))
    e = entries.select("eid", "evec", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"), F.pmod(F.xxhash64("eid"), F.lit(64)).cast("int").alias("_part"))
    both = q.join(e, "_b").select("qid", "eid", "_part", cosine_distance(F.col("qvec"), F.col("evec")).alias("distance"))
    first = Window.partitionBy("qid", "_part").orderBy(F.col("distance").asc_nulls_last(), "eid")
    kept = both.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("distance").asc_nulls_last(), "eid"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= n).select("qid", "eid", "distance", "rank")


def fuzzy_distance(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``qid, eid, distance`` of ``qid, eid, qtokens, etokens``: one less the
    fuzzy Jaccard of both token sets, with memberships by the most similar token."""
    tokens = pairs.select("qid", "eid", "qtokens", "etokens", F.explode(F.array_union("qtokens", "etokens")).alias("token"))
    sides = tokens.select("qid", "eid", "token", F.explode(F.concat(F.transform("qtokens", lambda t: F.struct(t.alias("t"), F.lit(True).alias("q"))), F.transform("etokens", lambda t: F.struct(t.alias("t"), F.lit(False).alias("q"))))).alias("_o"))
    sides = sides.select("qid", "eid", "token", F.col("_o.t").alias("other"), F.col("_o.q").alias("q"))
    a = vectors.select(F.col("token"), F.col("vec").alias("_a"))
    b = vectors.select(F.col("token").alias("other"), F.col("vec").alias("_b"))
    # Each pair of words is compared once.
    words = sides.select("token", "other").distinct().join(a, "token", "left").join(b, "other", "left")
    similar = F.when(F.col("token") == F.col("other"), 1.0).otherwise(token_similarity(F.col("_a"), F.col("_b")))
    known = materialise(words.select("token", "other", similar.alias("s")))
    best = sides.join(known, ["token", "other"]).groupBy("qid", "eid", "token").agg(
        F.coalesce(F.max(F.when(F.col("q"), F.col("s"))), F.lit(0.0)).alias("sq"), F.coalesce(F.max(F.when(~F.col("q"), F.col("s"))), F.lit(0.0)).alias("se")
    )
    total = best.groupBy("qid", "eid").agg(F.sum(F.col("sq") * F.col("se")).alias("u"), F.sum("sq").alias("i"), F.sum("se").alias("f"))
    return total.select("qid", "eid", (1 - F.coalesce(F.try_divide("u", F.col("i") + F.col("f") - F.col("u")), F.lit(0.0))).alias("distance"))


def match(names: DataFrame, foods: DataFrame, vectors: DataFrame, overrides: DataFrame | None = None, n: int = 50, most: float = 0.4) -> DataFrame:
    """``qid, fdc_id, confidence`` of ``qid, tokens`` (prepared stems) and ``fdc_id, tokens``.

    An override (``tokens, fdc_id``) of exactly these tokens wins with
    confidence 1; otherwise the best of the ``n`` nearest by fuzzy distance,
    if it is at most ``most``.  Names without a known token match nothing.
    """
    known = vectors.select("token")
    spelled = materialise(names.select("qid", normalise_spelling(F.col("tokens")).alias("tokens")))
    has = spelled.select("qid", F.explode("tokens").alias("token")).join(known, "token", "left_semi").select("qid").distinct()
    spelled = spelled.join(has, "qid", "left_semi")
    probability = materialise(token_probability(foods))
    factor = weight_factor(foods, probability)
    entries = embed(foods.select(F.col("fdc_id").alias("id"), "tokens"), vectors, probability, factor).select(F.col("id").alias("eid"), F.col("vec").alias("evec"))
    queries = embed(spelled.select(F.col("qid").alias("id"), "tokens"), vectors, probability, factor).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    close = nearest(materialise(queries), materialise(entries), n)
    cooked = F.arrays_overlap("tokens", F.array(*[F.lit(x) for x in COOKED]))
    q = spelled.select("qid", F.when(cooked, F.col("tokens")).otherwise(F.concat("tokens", F.array(F.lit("raw")))).alias("qtokens"))
    pairs = close.select("qid", "eid").join(q, "qid").join(foods.select(F.col("fdc_id").alias("eid"), F.col("tokens").alias("etokens")), "eid")
    best = fuzzy_distance(pairs, vectors).groupBy("qid").agg(F.min_by(F.struct("eid", "distance"), F.struct("distance", "eid")).alias("_b"))
    out = best.where(F.col("_b.distance") <= most).select("qid", F.col("_b.eid").alias("fdc_id"), F.bround(1 - F.col("_b.distance"), 6).alias("confidence"))
    if overrides is None:
        return out
    fixed = spelled.join(overrides.groupBy("tokens").agg(F.min("fdc_id").alias("fdc_id")), "tokens").select("qid", "fdc_id", F.lit(1.0).alias("confidence"))
    return fixed.unionByName(out.join(fixed.select("qid"), "qid", "left_anti"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of an array of tokens."""
    known: dict[str, str] = {}

    def stem(t: str) -> str:
        if t not in known:
            if len(known) > 200_000:
                known.clear()
            known[t] = porter(t)
        return known[t]

    for s in batches:
        yield s.map(lambda ts: None if ts is None else [stem(t) for t in ts])


def food_url(fdc_id: Column) -> Column:
    return F.concat(F.lit("https://fdc.nal.usda.gov/food-details/"), fdc_id.cast("string"), F.lit("/nutrients"))

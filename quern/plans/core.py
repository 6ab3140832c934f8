"""Queries over the tables of a data folder: name -> (query, DuckDB statement or None)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import normalise as nz
from quern.functions import rational, units
from quern.functions import tokens as tk
from quern.functions import vocab
from quern.operators import assemble, catalogue, clusters, crf, evaluation, experiments, features, quality, quantities, spans, structure
from quern.plans import parse
from quern.runtime import materialise, shared_dir, widened
from quern.sources import io
from quern.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = (f, sql)
        return f

    return add


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def rows(s: SparkSession, d: str) -> DataFrame:
    return widened(table(s, d, "training_rows"))


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, as sums in another order differ in the last digits."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _values(pairs: dict[str, str]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in pairs.items())


# -- amounts in common units ---------------------------------------------------


def _amounts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(s, d, "ingredient_amounts"), table(s, d, "composite_amounts"), table(s, d, "unit_defs")


query(name="p5_found")(lambda s, d: quantities.equal_amounts(quantities.common_amounts(*_amounts(s, d))))
query(name="p5_amounts")(lambda s, d: quantities.common_amounts(*_amounts(s, d)))
query(name="p5_unresolved")(lambda s, d: quantities.unresolved_units(*_amounts(s, d)))

# -- normalisation steps -------------------------------------------------------


def _step(name: str, f: Callable, sql: str | None) -> None:
    body = f"SELECT id, {sql} AS text FROM training_rows" if sql else None
    query(body, f"normalise_{name}")(lambda s, d: rows(s, d).select("id", f(F.col("sentence")).alias("text")))


_signs = "sentence"
for _sign, _text in vocab.FRACTION_SIGNS.items():
    _signs = f"replace(replace({_signs}, '-{_sign}', '-{_text}'), '{_sign}', ' {_text}')"
_NUM = r"[\d.]+|\d*#\d+\$\d+"
_step("prices", nz.drop_prices, r"regexp_replace(sentence, '\(\s*[$£€¥₹]\s*[0-9.,]+\**\s*\)', '', 'g')")
_step("dashes", nz.plain_dashes, "replace(replace(sentence, '–', '-'), '—', ' - ')")
_step("ascii_fractions", nz.ascii_fractions, _signs)
_step("and_fractions", nz.join_and_fractions, r"regexp_replace(sentence, '(\d+)\sand\s(\d)/(\d+)', '\1#\2$\3', 'g')")
_step("mark_fractions", nz.mark_fractions, r"regexp_replace(regexp_replace(replace(sentence, '⁄', '/'), '(\d+)\s+(\d)/(\d+)', '\1#\2$\3', 'g'), '(\d+)/(\d+)', '#\1$\2', 'g')")
_step("unit_periods", nz.drop_unit_periods, r"regexp_replace(sentence, '([Tt]sps?|[Tt]bsps?|[Tt]bs?|[Ll]bs?|[Oo]z)\.', '\1', 'g')")
_step("string_ranges", nz.string_ranges, r"regexp_replace(sentence, '(0\.[0-9]|[1-9][\d.]*?|\d*#\d+\$\d+)\s*(-)?\s*(to|or)\s*(-)*\s*((0\.[0-9]+|[1-9][\d.]*?|\d*#\d+\$\d+)(-)?)', '\1-\5', 'g')")
_step("times", nz.merge_times, rf"regexp_replace(sentence, '({_NUM})\s[xX]\s*', '\1x ', 'g')")
_step("collapse", nz.collapse_ranges, r"regexp_replace(sentence, '(\d)\s*-\s*([\d#])', '\1-\2', 'g')")
_step("punctuation", nz.fix_punctuation, r"trim(regexp_replace(replace(replace(replace(sentence, '( ', '('), ' )', ')'), ' / ', '/'), ' ([,:;.!?*])', '\1', 'g'), ' ')")
_words = "sentence"
for _word, _digits in vocab.STRING_NUMBERS.items():
    _words = rf"regexp_replace({_words}, '\b{_word}\b', '{_digits}', 'gi')"
_step("string_numbers", nz.string_numbers, _words)
_step("html", nz.unescape_html, None)
_step("split_units", nz.split_units, None)
_step("same_unit_ranges", nz.same_unit_ranges, None)
_step("full", nz.normalise, None)

# -- tokens --------------------------------------------------------------------

_SPACE = r"[\p{Z}\s\x0B\x{85}]+"
_TOKENS = rf"""
raw AS (SELECT id, regexp_extract_all(regexp_replace(sentence, '{_SPACE}', ' ', 'g'), '[()\[\]{{}},/:;?!*~]|[^ ()\[\]{{}},/:;?!*~]+') AS p FROM training_rows),
joined AS (SELECT id, string_split(replace(chr(1) || array_to_string(p, chr(1)) || chr(1), chr(1) || 'and' || chr(1) || '/' || chr(1) || 'or' || chr(1), chr(1) || 'and/or' || chr(1)), chr(1)) AS p FROM raw),
made AS (SELECT id, list_filter(flatten(list_transform(p, lambda t: CASE WHEN length(t) > 1 AND t LIKE '%.' AND NOT regexp_matches(t, '\.[A-Za-z0-9_]\.$') THEN [t[:-2], '.'] ELSE [t] END)), lambda t: t <> '') AS tokens FROM joined)"""


@query(f"WITH {_TOKENS} SELECT id, array_to_string(tokens, '|') AS tokens, coalesce(len(tokens), -1)::INT AS n FROM made")
def tokenise(s: SparkSession, d: str) -> DataFrame:
    t = tk.tokenise(F.col("sentence"))
    return rows(s, d).select("id", t.alias("t")).select("id", F.array_join("t", "|").alias("tokens"), F.coalesce(F.when(F.col("t").isNotNull(), F.size("t")), F.lit(-1)).alias("n"))


def _distinct_tokens(s: SparkSession, d: str) -> DataFrame:
    return rows(s, d).select(F.explode("tokens").alias("token")).distinct()


_D = r"\d(?:_?\d)*"
_ONE = rf"(?:\d*#\d+\$\d+(?:-\d*#\d+\$\d+)?|(?i:{'|'.join(vocab.STRING_NUMBERS)})|dozen|[+-]?(?:{_D}(?:\.(?:{_D})?)?|\.{_D})(?:[eE][+-]?{_D})?x?)"
_NUMERIC = f"regexp_matches(token, '^{_ONE}$') AND token <> '00' OR contains(token, '-') AND len(list_filter(string_split(token, '-'), lambda p: NOT (regexp_matches(p, '^{_ONE}$') AND p <> '00'))) = 0"
_PUNCT = "contains('" + vocab.PUNCTUATION.replace("'", "''") + "', token) OR token = '--'"


@query(f"""SELECT token, {_NUMERIC} AS numeric, lower(token) IN ({_quoted(sorted({*vocab.UNITS.values()}))}) AS unit, {_PUNCT} AS punctuation,
regexp_matches(token, '^[A-Z]') AS capitalised, token IN ({_quoted(vocab.AMBIGUOUS)}) AS ambiguous
FROM (SELECT DISTINCT unnest(tokens) AS token FROM training_rows)""")
def token_kinds(s: SparkSession, d: str) -> DataFrame:
    c = F.col("token")
    return _distinct_tokens(s, d).select(
        "token", tk.is_numeric(c).alias("numeric"), tk.is_unit(c).alias("unit"), tk.is_punctuation(c).alias("punctuation"), tk.is_capitalised(c).alias("capitalised"), tk.is_ambiguous_unit(c).alias("ambiguous")
    )


@query("""SELECT token, """ + ", ".join(f"CASE WHEN length(token) > {n} THEN token[1:{n}] END AS prefix_{n}, CASE WHEN length(token) > {n} THEN token[-{n}:] END AS suffix_{n}" for n in (3, 4, 5)) + """
FROM (SELECT DISTINCT unnest(tokens) AS token FROM training_rows)""")
def token_affixes(s: SparkSession, d: str) -> DataFrame:
    c = F.col("token")
    return _distinct_tokens(s, d).select("token", *[tk.affix(c, n, end).alias(f"{'suffix' if end else 'prefix'}_{n}") for n in (3, 4, 5) for end in (False, True)])


@query(r"""SELECT token, regexp_replace(regexp_replace(regexp_replace(nfc_normalize(strip_accents(token)), '[a-z]', 'x', 'g'), '[A-Z]', 'X', 'g'), '[0-9]', 'd', 'g') AS shape
FROM (SELECT DISTINCT unnest(tokens) AS token FROM training_rows)""")
def token_shapes(s: SparkSession, d: str) -> DataFrame:
    return _distinct_tokens(s, d).select("token", tk.word_shape(F.col("token")).alias("shape"))


@query()
def token_stems(s: SparkSession, d: str) -> DataFrame:
    return _distinct_tokens(s, d).select("token", tk.stem(F.col("token")).alias("stem"), tk.word_shape(F.col("token")).alias("shape"))


@query(f"""WITH u(plural, singular) AS (VALUES {_values(vocab.UNITS)}), t AS (SELECT DISTINCT unnest(tokens) AS token FROM training_rows)
SELECT t.token, coalesce(a.singular, t.token) AS singular, coalesce(b.plural, t.token) AS plural FROM t LEFT JOIN u a ON t.token = a.plural LEFT JOIN u b ON t.token = b.singular""")
def unit_forms(s: SparkSession, d: str) -> DataFrame:
    return _distinct_tokens(s, d).select("token", nz.singular_unit(F.col("token")).alias("singular"), nz.plural_unit(F.col("token")).alias("plural"))


_SYN = {u: str(n) for n, g in enumerate(vocab.SYNONYMS) for u in g}


@query(f"""WITH u(plural, singular) AS (VALUES {_values(vocab.UNITS)}), c(unit, k) AS (VALUES {_values(_SYN)}),
t AS (SELECT DISTINCT unnest(tokens) AS token FROM training_rows),
f AS (SELECT t.token, c.k FROM t LEFT JOIN u ON t.token = u.plural JOIN c ON coalesce(u.singular, t.token) = c.unit)
SELECT x.token AS a, y.token AS b FROM f x JOIN f y ON x.k = y.k AND x.token < y.token""")
def unit_synonyms(s: SparkSession, d: str) -> DataFrame:
    f = _distinct_tokens(s, d).withColumn("k", nz.unit_class(F.col("token"))).where("k is not null")
    return f.toDF("a", "k").join(f.toDF("b", "k"), "k").where("a < b").select("a", "b")


@query("""SELECT id, coalesce(list_max(list_filter([1, 2, 4, 8, 12, 16, 20, 32, 64], lambda b: b <= len(tokens))), 1) AS bucket FROM training_rows WHERE tokens IS NOT NULL""")
def length_buckets(s: SparkSession, d: str) -> DataFrame:
    return rows(s, d).where("tokens is not null").select("id", tk.length_bucket(F.size("tokens")).alias("bucket"))


@query("""SELECT id, id::VARCHAR || CASE WHEN id % 100 BETWEEN 11 AND 13 THEN 'th' WHEN id % 10 = 1 THEN 'st' WHEN id % 10 = 2 THEN 'nd' WHEN id % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal FROM training_rows""")
def ordinals(s: SparkSession, d: str) -> DataFrame:
    return rows(s, d).select("id", tk.ordinal(F.col("id")).alias("ordinal"))


# -- context and structure -----------------------------------------------------

_LONG = "long AS (SELECT id, unnest(tokens) AS token, unnest(range(len(tokens))) AS idx FROM training_rows)"


def _long(s: SparkSession, d: str) -> DataFrame:
    return rows(s, d).select(F.col("id").alias("sent_id"), F.size("tokens").alias("n_tokens"), F.posexplode("tokens").alias("idx", "raw"))


@query(f"""WITH {_LONG}, c AS (SELECT *, coalesce(sum((token IN ('(', '['))::INT) OVER b, 0) AS o, coalesce(sum((token IN (')', ']'))::INT) OVER b, 0) AS k, sum((token IN (')', ']'))::INT) OVER (PARTITION BY id) AS n,
 coalesce(max((token = ',')::INT) OVER b, 0) = 1 AS after_comma, coalesce(max((lower(token) = 'plus')::INT) OVER b, 0) = 1 AS after_plus FROM long
 WINDOW b AS (PARTITION BY id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id AS sent_id, idx, token IN ('(', ')', '[', ']') OR k < least(o, n) AS in_parens, after_comma, after_plus FROM c""")
def token_context(s: SparkSession, d: str) -> DataFrame:
    return features.context(_long(s, d).withColumnRenamed("raw", "feat_text")).select("sent_id", F.col("idx").cast("bigint").alias("idx"), "in_parens", "after_comma", "after_plus")


@query("""WITH long AS (SELECT id, unnest(labels) AS l, unnest(range(len(labels))) AS idx FROM training_rows)
SELECT id, idx, concat_ws('+', lag(l, 1) OVER w, l) AS prev, concat_ws('+', l, lead(l, 1) OVER w, lead(l, 2) OVER w) AS next2 FROM long WINDOW w AS (PARTITION BY id ORDER BY idx)""")
def label_ngrams(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy("idx")
    long = rows(s, d).select("id", F.posexplode("labels").alias("idx", "l"))
    return long.select("id", F.col("idx").cast("bigint").alias("idx"), F.concat_ws("+", F.lag("l").over(w), "l").alias("prev"), F.concat_ws("+", "l", F.lead("l").over(w), F.lead("l", 2).over(w)).alias("next2"))


@query()
def token_features(s: SparkSession, d: str) -> DataFrame:
    t = structure.token_flags(features.context(features.describe(_long(s, d))))
    return features.feature_maps(t).select("sent_id", "idx", F.to_json("features").alias("features"))


@query()
def tag_phrases(s: SparkSession, d: str) -> DataFrame:
    return structure.phrases(features.describe(_long(s, d)))


_ISLANDS = """long AS (SELECT id, unnest(tokens) AS token, unnest(labels) AS label, unnest(range(len(labels))) AS idx FROM training_rows WHERE len(tokens) = len(labels)),
g AS (SELECT *, idx - row_number() OVER (PARTITION BY id, label ORDER BY idx) AS island FROM long)"""


@query(f"WITH {_ISLANDS} SELECT id, label, min(idx) AS start, count(*) AS n, string_agg(token, ' ' ORDER BY idx) AS text FROM g GROUP BY id, label, island")
def label_islands(s: SparkSession, d: str) -> DataFrame:
    pairs = rows(s, d).where(F.size("tokens") == F.size("labels")).select("id", F.posexplode(F.arrays_zip("tokens", "labels")).alias("idx", "_x"))
    long = pairs.select("id", F.col("idx").cast("bigint").alias("idx"), F.col("_x.tokens").alias("token"), F.col("_x.labels").alias("label"))
    g = features.islands(long, ["id", "label"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "token"))), lambda x: x["token"]), " ")
    return g.groupBy("id", "label", "island").agg(F.min("idx").alias("start"), F.count(F.lit(1)).alias("n"), text.alias("text")).drop("island")


@query("""SELECT id, len(regexp_extract_all(array_to_string(list_transform(labels, lambda l: CASE l WHEN 'QTY' THEN 'Q' WHEN 'UNIT' THEN 'U' ELSE '_' END), ''), 'QU')) AS pairs,
len(regexp_extract_all(array_to_string(list_transform(list_filter(labels, lambda l: l IN ('QTY', 'UNIT')), lambda l: l[1]), ''), 'QUQU')) AS doubles FROM training_rows WHERE labels IS NOT NULL""")
def label_patterns(s: SparkSession, d: str) -> DataFrame:
    n = lambda p, o: F.size(structure.label_matches(F.col("labels"), p, o)).cast("bigint")
    return rows(s, d).where("labels is not null").select("id", n(["QTY", "UNIT"], False).alias("pairs"), n(["QTY", "UNIT", "QTY", "UNIT"], True).alias("doubles"))


def _labelled_long(s: SparkSession, d: str) -> DataFrame:
    pairs = rows(s, d).where(F.size("tokens") == F.size("labels")).select("id", F.posexplode(F.arrays_zip("tokens", "labels")).alias("idx", "_x"))
    return pairs.select(F.col("id").alias("sent_id"), F.col("idx").cast("bigint").alias("idx"), F.col("_x.tokens").alias("token"), F.col("_x.labels").alias("label"))


@query(f"""WITH long AS (SELECT id AS sent_id, unnest(tokens) AS token, unnest(labels) AS label, unnest(range(len(labels))) AS idx FROM training_rows WHERE len(tokens) = len(labels)),
t AS (SELECT *, lower(lag(token) OVER w) AS p, lower(lead(token) OVER w) AS n, sum((label = 'QTY')::INT) OVER w AS amount FROM long WINDOW w AS (PARTITION BY sent_id ORDER BY idx)),
a AS (SELECT sent_id, amount, min(idx) AS start, coalesce(string_agg(token, ' ' ORDER BY idx) FILTER (WHERE label = 'QTY'), '') AS quantity, coalesce(string_agg(token, ' ' ORDER BY idx) FILTER (WHERE label = 'UNIT'), '') AS unit,
 coalesce(bool_or(label = 'QTY' AND p IN ({_quoted(vocab.APPROXIMATE)})), false) AS a, coalesce(bool_or(label = 'UNIT' AND n IN ({_quoted(vocab.SINGULAR)})), false) AS s, coalesce(bool_or(label = 'QTY' AND p IN ('(', '[', '/')), false) AS linked
 FROM t WHERE label IN ('QTY', 'UNIT') GROUP BY sent_id, amount), g AS (SELECT *, sum((NOT linked)::INT) OVER (PARTITION BY sent_id ORDER BY amount) AS g FROM a)
SELECT sent_id, amount::BIGINT AS amount, start, quantity, unit, bool_or(a) OVER w AS approximate, bool_or(s) OVER w AS singular FROM g WINDOW w AS (PARTITION BY sent_id, g)""")
def amount_groups(s: SparkSession, d: str) -> DataFrame:
    return spans.amount_groups(_labelled_long(s, d))


@query("""WITH long AS (SELECT id AS sent_id, unnest(tokens) AS token, unnest(labels) AS label, unnest(range(len(labels))) AS idx FROM training_rows WHERE len(tokens) = len(labels)),
t AS (SELECT *, lag(label) OVER (PARTITION BY sent_id ORDER BY idx) AS p FROM long WHERE contains(label, 'NAME')),
g AS (SELECT *, sum((starts_with(label, 'B_') OR label = 'NAME_SEP' OR p IS NULL OR p = 'NAME_SEP' OR label IN ('NAME_MOD', 'NAME_VAR') AND p <> label)::INT) OVER (PARTITION BY sent_id ORDER BY idx) AS part FROM t)
SELECT sent_id, part::BIGINT AS part, regexp_extract(arg_min(label, idx), '([A-Z]+)$', 1) AS kind, min(idx) AS start, string_agg(token, ' ' ORDER BY idx) AS text FROM g WHERE label <> 'NAME_SEP' GROUP BY sent_id, part""")
def name_groups(s: SparkSession, d: str) -> DataFrame:
    return spans.name_groups(_labelled_long(s, d))


# -- records -------------------------------------------------------------------


def _records(s: SparkSession, d: str) -> DataFrame:
    fit = rows(s, d).where((F.size("tokens") == F.size("labels")) & ~F.array_contains("labels", "OTHER"))
    tokens = F.transform(F.arrays_zip("tokens", "labels"), lambda x: F.when(x["labels"] == "UNIT", nz.singular_unit(x["tokens"])).otherwise(x["tokens"]))
    marked = F.transform(tokens, lambda t: nz.mark_fractions(F.trim(nz.ascii_fractions(t))))
    tags = F.transform("tokens", lambda t: features.fixed_pos(t, features.rule_pos(t)))
    scores = F.transform("tokens", lambda _: F.lit(1.0))
    return fit.select("id", marked.alias("t"), tags.alias("p"), "labels", scores.alias("s")).select("id", assemble.record(F.col("t"), F.col("p"), F.col("labels"), F.col("s")).alias("r"))


@query()
def records(s: SparkSession, d: str) -> DataFrame:
    return _records(s, d).select("id", F.to_json("r").alias("record"))


@query()
def amounts_by_unit(s: SparkSession, d: str) -> DataFrame:
    a = _records(s, d).select(F.explode("r.amount").alias("a")).select("a.*")
    return a.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum(rational.as_double(F.col("quantity"))).alias("total"), F.count_if("range").alias("ranges"))


@query("""SELECT id, sentence, """ + ", ".join(
    f"""array_to_string(list_transform(list_filter(list_zip(tokens, labels), lambda x: {'contains(x[2], ' + chr(39) + 'NAME' + chr(39) + ')' if lab == 'NAME' else 'x[2] = ' + chr(39) + lab + chr(39)}), lambda x: x[1]), ' ') AS {c}"""
    for c, lab in io._EXPORT_LABELS.items()
) + " FROM training_rows WHERE len(tokens) = len(labels)")
def export_rows(s: SparkSession, d: str) -> DataFrame:
    return io.export_rows(rows(s, d).where(F.size("tokens") == F.size("labels")))


@query(r"""WITH q AS (SELECT DISTINCT quantity FROM ingredient_amounts WHERE regexp_matches(quantity, '^\d*#\d+\$\d+$')),
p AS (SELECT quantity, coalesce(try_cast(regexp_extract(quantity, '^(\d*)#', 1) AS BIGINT), 0) * regexp_extract(quantity, '\$(\d+)$', 1)::BIGINT + regexp_extract(quantity, '#(\d+)', 1)::BIGINT AS n, regexp_extract(quantity, '\$(\d+)$', 1)::BIGINT AS k FROM q)
SELECT quantity, n // gcd(n, k) AS num, k // gcd(n, k) AS den FROM p""")
def rationals(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "ingredient_amounts").select("quantity").where(F.col("quantity").rlike(r"^\d*#\d+\$\d+$")).distinct()
    r = q.withColumn("r", rational.from_token(F.col("quantity")))
    return r.select("quantity", F.col("r.num").cast("bigint").alias("num"), F.col("r.den").cast("bigint").alias("den"))


@query("""SELECT a.unit AS a, b.unit AS b, round(CASE WHEN a.dimension = b.dimension THEN a.factor_to_base WHEN a.dimension = 'volume' THEN a.factor_to_base * 0.9 ELSE a.factor_to_base / 0.9 END / b.factor_to_base, 6) AS factor FROM unit_defs a JOIN unit_defs b ON b.unit IN ('gram', 'cup')""")
def conversions(s: SparkSession, d: str) -> DataFrame:
    both = table(s, d, "unit_defs").select(F.col("unit").alias("a"), F.explode(F.array(F.lit("gram"), F.lit("cup"))).alias("b"))
    return _rounded(both.select("a", "b", units.converted(F.lit(1.0), F.col("a"), F.col("b"), 0.9).alias("factor")))


# -- sequence labelling --------------------------------------------------------


def _rule_weights(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Hand-set weights of a few attributes; a baseline, not a trained model."""
    state = [("pos=CD", "QTY", 4.0), ("is_unit", "UNIT", 4.0), ("is_punc", "PUNC", 6.0), ("pos=VBN", "PREP", 3.0), ("pos=RB", "PREP", 2.0), ("pos=IN", "COMMENT", 2.0), ("pos=NN", "B_NAME_TOK", 1.0), ("pos=NNS", "B_NAME_TOK", 1.0), ("is_after_comma", "COMMENT", 1.5)]
    trans = [("B_NAME_TOK", "B_NAME_TOK", -3.0), ("B_NAME_TOK", "I_NAME_TOK", 1.5), ("I_NAME_TOK", "I_NAME_TOK", 1.5), ("QTY", "UNIT", 1.0), ("COMMENT", "COMMENT", 1.0)]
    return s.createDataFrame(state, "attr string, label string, w double"), s.createDataFrame(trans, "src string, dst string, w double")


@query()
def crf_tags(s: SparkSession, d: str) -> DataFrame:
    t = features.context(features.describe(_long(s, d)))
    attrs = materialise(features.attributes(features.feature_maps(t)))
    decoded = crf.guess_names(crf.tag(attrs, *_rule_weights(s), vocab.LABELS), vocab.LABELS)
    return decoded.select("sent_id", F.array_join("labels", " ").alias("labels"), F.transform("scores", lambda x: F.round(x, 4)).alias("scores"))


def _training(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All attributes and the truth of the labelled rows."""
    fit = quality.without_other(rows(s, d))
    long = fit.select(F.col("id").alias("sent_id"), F.size("tokens").alias("n_tokens"), F.posexplode("tokens").alias("idx", "raw"))
    maps = features.feature_maps(structure.token_flags(features.context(features.describe(long))))
    return features.attributes(maps), fit.select(F.col("id").alias("sent_id"), "labels", "source")


@query()
def crf_evaluate(s: SparkSession, d: str) -> DataFrame:
    """Metrics on a stratified fifth of the labelled rows, of weights trained on the rest."""
    return evaluation.label_metrics(experiments.run(*_runs(s, d))[2])


@query()
def parse_sentences(s: SparkSession, d: str) -> DataFrame:
    """Sentences to records, end to end, with the hand-set weights."""
    out = parse.parse(rows(s, d), "id", "sentence", *_rule_weights(s))
    return out.select("sent_id", "sentence", F.to_json(F.struct("name", "size", "amount", "preparation", "comment", "purpose")).alias("record"))


_EMIT = "CASE WHEN regexp_matches(token, '^[0-9]') THEN 'QTY' WHEN lower(token) IN (" + _quoted(sorted({*vocab.UNITS.values()})) + f") THEN 'UNIT' WHEN {_PUNCT} THEN 'PUNC' ELSE 'B_NAME_TOK' END"


def _judged(s: SparkSession, d: str) -> DataFrame:
    """Stored labels against those of a lexicon."""
    fit = rows(s, d).where(F.size("tokens") == F.size("labels"))
    long = fit.select(F.col("id").alias("sent_id"), "source", F.posexplode(F.arrays_zip("tokens", "labels")).alias("idx", "_x"))
    token = F.col("_x.tokens")
    pred = F.when(token.rlike("^[0-9]"), "QTY").when(tk.is_unit(token), "UNIT").when(tk.is_punctuation(token), "PUNC").otherwise("B_NAME_TOK")
    return long.select("sent_id", "source", "idx", token.alias("token"), F.col("_x.labels").alias("truth"), pred.alias("pred"))


_JUDGED = f"j AS (SELECT *, {_EMIT} AS pred FROM (SELECT id, source, unnest(tokens) AS token, unnest(labels) AS truth FROM training_rows WHERE len(tokens) = len(labels)))"


@query(f"""WITH {_JUDGED}, l AS (SELECT DISTINCT truth AS label FROM j UNION SELECT DISTINCT pred FROM j),
c AS (SELECT label, count(*) FILTER (WHERE truth = label AND pred = label) AS tp, count(*) FILTER (WHERE pred = label) AS np, count(*) FILTER (WHERE truth = label) AS support FROM l JOIN j ON truth = label OR pred = label GROUP BY label),
e AS (SELECT label, CASE WHEN np = 0 THEN 0 ELSE tp / np END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall, CASE WHEN np + support = 0 THEN 0 ELSE 2 * tp / (np + support) END AS f1, support FROM c),
u AS (SELECT * FROM e UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM e
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM e)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM u""")
def label_metrics(s: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.label_metrics(_judged(s, d)))


@query(f"""WITH {_JUDGED}, p AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE truth = pred) AS ok FROM j GROUP BY id)
SELECT sum(n)::BIGINT AS tokens, round(sum(ok) / sum(n), 6) AS token_accuracy, count(*) AS sentences, round(avg((n = ok)::INT), 6) AS sentence_accuracy FROM p""")
def label_accuracy(s: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.accuracy(_judged(s, d)))


@query(f"WITH {_JUDGED} SELECT truth, " + ", ".join(f"count(*) FILTER (WHERE pred = '{p}') AS \"{p}\"" for p in ("B_NAME_TOK", "PUNC", "QTY", "UNIT")) + " FROM j GROUP BY truth")
def label_confusion(s: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(_judged(s, d), ["B_NAME_TOK", "PUNC", "QTY", "UNIT"])


@query(f"WITH {_JUDGED} SELECT source, token, count(*) FILTER (WHERE truth = pred) AS correct, count(*) FILTER (WHERE truth <> pred) AS incorrect FROM j GROUP BY source, token")
def results_by_token(s: SparkSession, d: str) -> DataFrame:
    return evaluation.results_by(_judged(s, d), "source", "token")


@query(f"WITH {_JUDGED} SELECT id AS sent_id, count(*) FILTER (WHERE truth <> pred) AS n_wrong FROM j GROUP BY id HAVING count(*) FILTER (WHERE truth <> pred) > 0")
def mismatches(s: SparkSession, d: str) -> DataFrame:
    return evaluation.mismatches(_judged(s, d))


@query("""WITH r AS (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY md5(id::VARCHAR), id) AS k, count(*) OVER (PARTITION BY source) AS n FROM training_rows)
SELECT id, source, k <= floor(n * 0.2 + 0.5) AS is_test FROM r""")
def stratified_split(s: SparkSession, d: str) -> DataFrame:
    return evaluation.stratified_split(rows(s, d).select("id", "source"), "id", "source")


_SEEDS = (1, 2, 3, 4)


@query(f"""WITH {_JUDGED}, seeds(seed) AS (VALUES (1), (2), (3), (4)), ids AS (SELECT DISTINCT id, source FROM j),
k AS (SELECT seed, id, row_number() OVER (PARTITION BY seed, source ORDER BY md5(id::VARCHAR || seed::VARCHAR), id) AS r, count(*) OVER (PARTITION BY seed, source) AS n FROM ids, seeds),
p AS (SELECT seed, k.id, count(*) AS n, count(*) FILTER (WHERE truth = pred) AS ok FROM k JOIN j ON j.id = k.id WHERE r <= floor(k.n * 0.2 + 0.5) GROUP BY seed, k.id),
r AS (SELECT seed, sum(ok) / sum(n) AS t, avg((n = ok)::INT) AS s FROM p GROUP BY seed)
SELECT round(avg(t), 6) AS token_mean, round(3 * stddev_samp(t), 6) AS token_3sd, round(avg(s), 6) AS sentence_mean, round(3 * stddev_samp(s), 6) AS sentence_3sd,
(SELECT seed FROM r ORDER BY s DESC, seed LIMIT 1) AS best_seed, (SELECT seed FROM r ORDER BY s, seed LIMIT 1) AS worst_seed FROM r""")
def run_summary(s: SparkSession, d: str) -> DataFrame:
    """The lexicon's accuracy on four stratified test splits of the labelled rows."""
    judged = materialise(_judged(s, d))
    ids = judged.select("sent_id", "source").distinct()
    runs = None
    for seed in _SEEDS:
        test = evaluation.stratified_split(ids, "sent_id", "source", 0.2, str(seed)).where("is_test").select("sent_id")
        one = evaluation.accuracy(judged.join(test, "sent_id", "left_semi")).select(F.lit(seed).alias("seed"), "token_accuracy", "sentence_accuracy")
        runs = one if runs is None else runs.unionByName(one)
    return _rounded(evaluation.run_summary(runs))


@query(f"WITH {_JUDGED} SELECT token, truth, pred, count(*) AS n FROM j WHERE truth <> pred GROUP BY token, truth, pred")
def misclassified_tokens(s: SparkSession, d: str) -> DataFrame:
    return evaluation.misclassified(_judged(s, d))


@query(f"WITH {_JUDGED} SELECT id AS sent_id, count(*) AS n_tokens, count(*) FILTER (WHERE truth <> pred) AS n_wrong, round(1 - count(*) FILTER (WHERE truth <> pred) / count(*), 6) AS share_right FROM j GROUP BY id")
def results_by_sentence(s: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.sentence_results(_judged(s, d)))


@query(f"""WITH {_JUDGED}, p AS (SELECT source, id, count(*) FILTER (WHERE truth <> pred) > 0 AS wrong, min(1.0 / length(token)) <= 0.1 AS low FROM j GROUP BY source, id)
SELECT source, count(*) AS n_sentences, count(*) FILTER (WHERE wrong) AS n_mismatched, count(*) FILTER (WHERE low) AS n_low, round(100 * count(*) FILTER (WHERE wrong) / count(*), 6) AS percent FROM p GROUP BY source""")
def mismatch_shares(s: SparkSession, d: str) -> DataFrame:
    """Shares by source; the score of a token is that of the lexicon, which is surer of short tokens."""
    scored = _judged(s, d).withColumn("score", 1 / F.length("token"))
    return _rounded(evaluation.mismatch_shares(scored, "score", 0.1))


@query(f"""WITH {_JUDGED}, f AS (SELECT truth, pred, unnest(['token=' || lower(token), 'first=' || token[1:1], 'length=' || length(token)]) AS feature FROM j)
SELECT feature, count(*) FILTER (WHERE truth = pred) AS correct, count(*) FILTER (WHERE truth <> pred) AS incorrect FROM f GROUP BY feature""")
def results_by_feature(s: SparkSession, d: str) -> DataFrame:
    t = F.col("token")
    features_ = F.array(F.concat(F.lit("token="), F.lower(t)), F.concat(F.lit("first="), F.left(t, F.lit(1))), F.concat(F.lit("length="), F.length(t).cast("string")))
    return evaluation.results_by(_judged(s, d).select("truth", "pred", F.explode(features_).alias("feature")), "feature")


def _runs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """The labelled rows with their tokens, from which the runs take the attributes of ``_training``."""
    fit = quality.without_other(rows(s, d)).select(F.col("id").alias("sent_id"), F.col("tokens").alias("raw"), "labels", "source")
    return fit.drop("source"), fit.drop("raw"), vocab.LABELS


@query()
def train_multiple(s: SparkSession, d: str) -> DataFrame:
    """Ten training runs over seeds, each on another stratified split of all labelled rows."""
    return experiments.repeated(*_runs(s, d), seeds=range(1, 11))


@query()
def grid_search(s: SparkSession, d: str) -> DataFrame:
    """Training runs over combinations of parameters."""
    return experiments.grid_search(*_runs(s, d), {"c1": [0.0, 0.6], "c2": [0.1, 0.5], "rate": [0.2, 0.5, 1.0]})


@query()
def feature_search(s: SparkSession, d: str) -> DataFrame:
    """Training runs with all features, and without some."""
    places = ("", "prev_", "prev2_", "prev3_", "next_", "next2_", "next3_")
    return experiments.feature_search(*_runs(s, d), {"none": [], "ambiguous": [f"{p}is_ambiguous" for p in places], "affixes": [f"{k}_{n}" for k in ("prefix", "suffix") for n in (3, 4, 5)]})


# -- checks and searches -------------------------------------------------------


@query("SELECT id, coalesce(len(tokens), 0)::INT AS n_tokens, coalesce(len(labels), 0)::INT AS n_labels FROM training_rows WHERE coalesce(len(tokens), 0) <> coalesce(len(labels), 0)")
def length_mismatches(s: SparkSession, d: str) -> DataFrame:
    return quality.length_mismatches(rows(s, d))


@query("SELECT sentence, count(*) AS n_rows, count(DISTINCT labels) AS n_labellings FROM training_rows WHERE sentence IS NOT NULL GROUP BY sentence HAVING count(DISTINCT labels) > 1")
def conflicting_sentences(s: SparkSession, d: str) -> DataFrame:
    return quality.conflicting_sentences(rows(s, d).where("labels is not null"))


@query("""WITH long AS (SELECT id, unnest(labels) AS label, unnest(range(len(labels))) AS idx FROM training_rows),
b AS (SELECT *, lag(label) OVER (PARTITION BY id ORDER BY idx) AS prev FROM long WHERE label LIKE 'B\\_%' ESCAPE '\\' OR label LIKE 'I\\_%' ESCAPE '\\')
SELECT id, idx, label FROM b WHERE label LIKE 'I\\_%' ESCAPE '\\' AND (prev IS NULL OR prev[3:] <> label[3:])""".replace("\\\\", "\\"))
def broken_bio(s: SparkSession, d: str) -> DataFrame:
    return quality.broken_bio(rows(s, d)).select("id", F.col("idx").cast("bigint").alias("idx"), "label")


@query(f"WITH {_TOKENS} SELECT t.id, len(t.tokens) AS n_stored, len(m.tokens) AS n_computed FROM training_rows t JOIN made m ON t.id = m.id WHERE t.tokens IS DISTINCT FROM m.tokens")
def token_mismatches(s: SparkSession, d: str) -> DataFrame:
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("bigint")
    return quality.token_mismatches(rows(s, d), tk.tokenise(F.col("sentence"))).select("id", size("stored").alias("n_stored"), size("computed").alias("n_computed"))


@query("SELECT id, list_transform(labels, lambda l: CASE WHEN contains(l, 'NAME') THEN 'NAME' ELSE l END) AS labels FROM training_rows WHERE NOT list_contains(labels, 'OTHER') AND len(tokens) = len(labels)")
def training_input(s: SparkSession, d: str) -> DataFrame:
    return quality.without_other(rows(s, d), merge_names=True).select("id", "labels")


@query("""WITH t AS (SELECT id, tokens, labels, list_transform(tokens, lambda x: lower(x)) AS low FROM training_rows),
p AS (SELECT *, coalesce(list_min(list_filter(range(len(low) - 1), lambda i: low[i + 1] = 'red' AND low[i + 2] = 'lentils')), -1) AS place FROM t)
SELECT id, place::INT AS place FROM p WHERE place >= 0 AND len(list_filter(labels[place + 1:place + 2], lambda l: l NOT IN ('B_NAME_TOK', 'I_NAME_TOK'))) = 0""")
def token_search(s: SparkSession, d: str) -> DataFrame:
    return quality.search(rows(s, d), ["red", "lentils"], ["B_NAME_TOK", "I_NAME_TOK"]).select("id", "place")


@query("SELECT id, source FROM training_rows WHERE id = 7 OR id BETWEEN 100 AND 160 OR id = 2049")
def id_search(s: SparkSession, d: str) -> DataFrame:
    return quality.by_ids(rows(s, d).select("id", "source"), "7,100..160,2049")


@query("SELECT t.id, t.source FROM training_rows t WHERE id IN (SELECT o_custkey FROM orders)")
def id_table_search(s: SparkSession, d: str) -> DataFrame:
    return quality.by_id_table(rows(s, d).select("id", "source"), table(s, d, "orders").select(F.col("o_custkey").alias("id")))


@query("SELECT id, sentence FROM training_rows ORDER BY id LIMIT 250 OFFSET 500")
def result_page(s: SparkSession, d: str) -> DataFrame:
    return quality.page(rows(s, d).select("id", "sentence"), 500)


@query("SELECT DISTINCT source FROM training_rows WHERE source IS NOT NULL")
def available_sources(s: SparkSession, d: str) -> DataFrame:
    return quality.sources(rows(s, d))


@query("""SELECT id, source FROM training_rows WHERE data_split IS DISTINCT FROM 'val' AND data_split IS DISTINCT FROM 'test'
UNION ALL SELECT id, 'checked' FROM training_rows WHERE data_split = 'val'""")
def upsert(s: SparkSession, d: str) -> DataFrame:
    t = rows(s, d).select("id", "source", "data_split")
    changed = t.where("data_split = 'val'").select("id", F.lit("checked").alias("source"))
    return quality.upsert(t.select("id", "source"), changed, t.where("data_split = 'test'"))


@query()
def label_clusters(s: SparkSession, d: str) -> DataFrame:
    return clusters.sentence_clusters(rows(s, d).select("id", "tokens"), 40)


@query("""SELECT id, source, (SELECT count(*) FROM training_rows) AS total FROM training_rows ORDER BY id LIMIT 250 OFFSET 250""")
def search_all(s: SparkSession, d: str) -> DataFrame:
    return quality.dispatch(rows(s, d).select("id", "source"), "**", 250)


@query("""WITH f AS (SELECT id, source FROM training_rows WHERE id IN (3, 11) OR id BETWEEN 20 AND 900) SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY id LIMIT 250""")
def search_ids(s: SparkSession, d: str) -> DataFrame:
    return quality.dispatch(rows(s, d).select("id", "source"), "==3,11,20..900")


@query("""WITH t AS (SELECT id, list_transform(tokens, lambda x: lower(x)) AS low FROM training_rows),
f AS (SELECT id FROM t WHERE len(list_filter(range(len(low) - 1), lambda i: low[i + 1] = 'olive' AND low[i + 2] = 'oil')) > 0) SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY id LIMIT 250""")
def search_words(s: SparkSession, d: str) -> DataFrame:
    return quality.dispatch(rows(s, d).select("id", "tokens", "labels"), "olive oil").select("id", "total")


@query("""WITH l AS (SELECT sentence, row_number() OVER (PARTITION BY sentence ORDER BY id) AS k, id AS line FROM training_rows WHERE sentence IS NOT NULL),
r AS (SELECT sentence, id, row_number() OVER (PARTITION BY sentence ORDER BY id) AS k FROM training_rows WHERE data_split = 'train')
SELECT l.line, l.sentence, r.id FROM l LEFT JOIN r ON l.sentence = r.sentence AND l.k = r.k""")
def matched_export(s: SparkSession, d: str) -> DataFrame:
    lines = rows(s, d).where("sentence is not null").select(F.col("id").alias("line"), "sentence")
    return io.matched_export(rows(s, d).where("data_split = 'train'").select("id", "sentence"), lines).select("line", "sentence", "id")


@query("SELECT fdc_id, data_type, description, category FROM fdc_ingredients")
def catalogue_round_trip(s: SparkSession, d: str) -> DataFrame:
    """The catalogue written as compressed CSV to the shared folder and read back."""
    path = f"{shared_dir(s)}/quern-exports/{uuid.uuid4().hex}"
    io.write_food_catalogue(table(s, d, "fdc_ingredients"), path)
    return io.food_catalogue(s, path)


@query("SELECT 'v' || vec_id AS token, round(list_sum(embedding::DOUBLE[]), 3) AS total, len(embedding)::INT AS n FROM embeddings")
def vectors_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Vectors written as text lines, with a header and a broken line, and read back."""
    path = f"{shared_dir(s)}/quern-exports/{uuid.uuid4().hex}"
    lines = table(s, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(" "), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).alias("value"))
    head = s.createDataFrame([("2 2",), ("broken 1.0 x",)], "value string")
    head.unionByName(lines).write.text(path)
    v = io.vectors(s, path)
    return v.select("token", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("total"), F.size("vec").alias("n"))


@query("SELECT id, source, len(tokens)::INT AS n_tokens, len(labels)::INT AS n_labels FROM training_rows WHERE source IS NOT NULL AND source IN (SELECT DISTINCT source FROM training_rows WHERE source IS NOT NULL ORDER BY source LIMIT 2)")
def sources_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Labelled rows kept as JSON text, read back for two sources."""
    path = f"{shared_dir(s)}/quern-exports/{uuid.uuid4().hex}"
    lists = [F.to_json(c).alias(c) for c in ("tokens", "labels", "foundation_foods", "sentence_split")]
    rows(s, d).select("id", "source", "sentence", *lists).write.parquet(path)
    two = [r["source"] for r in quality.sources(rows(s, d)).orderBy("source").limit(2).collect()]
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return io.labelled_sentences(s, path, two).select("id", "source", size("tokens").alias("n_tokens"), size("labels").alias("n_labels"))


@query("""WITH p AS (SELECT amount_id, is_subtractive, unnest(range(len(amounts))) AS i, unnest(amounts) AS a, len(amounts) AS n FROM composite_amounts),
k AS (SELECT amount_id, n, CASE WHEN is_subtractive AND i > 0 THEN -1 ELSE 1 END * a.quantity::DOUBLE * CASE a.unit WHEN 'gram' THEN 1 WHEN 'kilogram' THEN 1000 WHEN 'ounce' THEN 28.349523125 WHEN 'pound' THEN 453.59237 END AS v
FROM p WHERE regexp_matches(a.quantity, '^[0-9]+([.][0-9]+)?$') AND a.unit IN ('gram', 'kilogram', 'ounce', 'pound'))
SELECT amount_id, round(sum(v), 6) AS grams FROM k GROUP BY amount_id, n HAVING count(*) = n""")
def composite_conversions(s: SparkSession, d: str) -> DataFrame:
    """Composites whose parts are all plain numbers of these mass units, in grams."""
    plain = F.forall("amounts", lambda a: F.coalesce(a["quantity"].rlike(r"^[0-9]+([.][0-9]+)?$") & a["unit"].isin("gram", "kilogram", "ounce", "pound"), F.lit(False)))
    parts = F.transform("amounts", lambda a: F.struct(a["quantity"].cast("double").alias("value"), a["unit"].alias("unit")))
    t = table(s, d, "composite_amounts").where(plain & (F.size("amounts") > 0))
    return _rounded(t.select("amount_id", units.combined(parts, F.lit("gram"), F.coalesce("is_subtractive", F.lit(False))).alias("grams")))


@query()
def inspected(s: SparkSession, d: str) -> DataFrame:
    """Everything the parse knows of a sentence: tokens, tags, labels, scores and marginals."""
    out = parse.inspect(rows(s, d), "id", "sentence", *_rule_weights(s))
    places = lambda c: F.transform(c, lambda x: F.round(x, 4))
    return out.select("sent_id", "raw", "tokens", "tags", "labels", places("scores").alias("scores"), F.transform("marginals", places).alias("marginals"))


@query("""SELECT event_type, user_id, count(*) AS n FROM events GROUP BY event_type, user_id""")
def streamed_users(s: SparkSession, d: str) -> DataFrame:
    """Counts per type and user on a stream, run to its end in update mode."""
    schema = table(s, d, "events").select("event_type", "user_id").schema
    stream = s.readStream.schema(schema).parquet(live.files(d, "events"))
    return live.run_updates(stream.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n")), ["event_type", "user_id"])


@query()
def streamed_tokens(s: SparkSession, d: str) -> DataFrame:
    """The row-local parts on a stream over the files, run once to its end."""
    kept = rows(s, d).select("id", "sentence", "loaded_at").schema
    stream = s.readStream.schema(kept).parquet(live.files(d, "training_rows"))
    return live.run_once(live.tokenised(stream).select("id", "normalised", "tokens"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts::TIMESTAMP) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def streamed_counts(s: SparkSession, d: str) -> DataFrame:
    schema = table(s, d, "events").select("ts", "event_type").schema
    stream = s.readStream.schema(schema).parquet(live.files(d, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    return live.run_updates(live.counts(stream, "ts", "event_type", "1 day"), ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


# -- catalogue and similarity --------------------------------------------------


def _foods(s: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("description"), F.lit(r"\p{L}+"), F.lit(0))
    return table(s, d, "fdc_ingredients").select("fdc_id", words.alias("tokens"))


_FOODS = r"f AS (SELECT fdc_id, regexp_extract_all(lower(description), '\p{L}+') AS tokens FROM fdc_ingredients), c AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM f) GROUP BY token), p AS (SELECT token, n, n / (SELECT sum(n) FROM c) AS p FROM c)"


@query(f"WITH {_FOODS} SELECT token, n, round(p, 6) AS p FROM p")
def token_probability(s: SparkSession, d: str) -> DataFrame:
    return _rounded(catalogue.token_probability(_foods(s, d)))


@query(f"""WITH {_FOODS}, v AS (SELECT count(*)::DOUBLE AS v, min(p) AS min_p FROM p), n AS (SELECT floor(avg(len(tokens))) AS l FROM f),
k AS (SELECT count(*) AS k FROM p, v, n WHERE p.p > 1 - pow(1 - 1 / v.v, n.l)) SELECT round((1 - k / v) / (k / v * 0.5 * v), 6) AS a, round(min_p, 6) AS min_p FROM v, k""")
def weight_factor(s: SparkSession, d: str) -> DataFrame:
    factor = catalogue.weight_factor(_foods(s, d), catalogue.token_probability(_foods(s, d)))
    return _rounded(s.createDataFrame([factor], "a double, min_p double"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS qid, b.vec_id AS eid, 1 - list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) AS distance FROM e a JOIN e b ON a.vec_id % 100 = 0)
SELECT qid, eid, round(distance, 6) + 0.0 AS distance, row_number() OVER (PARTITION BY qid ORDER BY distance, eid)::INT AS rank FROM s QUALIFY rank <= 50""")
def nearest_vectors(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return catalogue.nearest(q, e.select(F.col("vec_id").alias("eid"), F.col("embedding").alias("evec"))).withColumn("distance", F.round("distance", 6) + 0.0)


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT vec_id, v, list_avg(list_filter(v, lambda x: x < 0)) AS lo, list_avg(list_filter(v, lambda x: x > 0)) AS hi FROM e)
SELECT vec_id, array_to_string(list_transform(v, lambda x: CASE WHEN x < lo THEN 'VNEG' WHEN x > hi THEN 'VPOS' ELSE 'V0' END), ' ') AS signs FROM m""")
def binarised_vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", F.array_join(catalogue.binarised(F.col("embedding").cast("array<double>")), " ").alias("signs"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.vec_id, CASE WHEN list_distance(a.v, b.v) = 0 THEN 1 ELSE round(1 / (1 + exp(-1 / list_distance(a.v, b.v))), 9) END AS similarity FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def vector_similarity(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(b, "vec_id").select("vec_id", F.round(catalogue.token_similarity(F.col("embedding"), F.col("b")), 9).alias("similarity"))


_PART = "SELECT p_partkey AS fdc_id, CASE p_size % 4 WHEN 0 THEN 'foundation_food' WHEN 1 THEN 'sr_legacy_food' WHEN 2 THEN 'survey_fndds_food' ELSE 'other' END AS data_type, p_name AS description, DATE '1995-01-01' + p_size AS publication_date FROM part"


@query(f"""WITH x AS ({_PART.replace('p_size AS pub', 'p_size::INT AS pub')}) SELECT fdc_id, data_type, description, publication_date::VARCHAR AS publication_date FROM x
QUALIFY row_number() OVER (PARTITION BY description ORDER BY CASE data_type WHEN 'foundation_food' THEN 1 WHEN 'sr_legacy_food' THEN 2 WHEN 'survey_fndds_food' THEN 3 ELSE 4 END, publication_date DESC, fdc_id) = 1""")
def preferred_entries(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 4 == 0, "foundation_food").when(F.col("p_size") % 4 == 1, "sr_legacy_food").when(F.col("p_size") % 4 == 2, "survey_fndds_food").otherwise("other")
    foods = table(s, d, "part").select(F.col("p_partkey").alias("fdc_id"), kind.alias("data_type"), F.col("p_name").alias("description"), F.date_add(F.lit("1995-01-01").cast("date"), F.col("p_size")).alias("publication_date"))
    return catalogue.preferred_entries(foods).withColumn("publication_date", F.col("publication_date").cast("string"))


@query("SELECT coalesce(n.n_nationkey, r.r_regionkey) AS id, coalesce(n.n_name, r.r_name) AS category FROM nation n FULL JOIN region r ON n.n_nationkey = r.r_regionkey")
def category_map(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("category"))
    return catalogue.category_map(a, table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("category")))


@query()
def food_matches(s: SparkSession, d: str) -> DataFrame:
    """Typed names against the catalogue by vectors; the vectors of the words are those of the embeddings table, by the word's rank."""
    foods = _foods(s, d).select("fdc_id", catalogue.stems("tokens").alias("tokens"))
    words = foods.select(F.explode("tokens").alias("token")).distinct()
    # Few words (those of the fixed catalogue), so one task ranks them.
    ranked = words.withColumn("vec_id", F.row_number().over(Window.orderBy("token")).cast("bigint"))
    vectors = materialise(ranked.join(table(s, d, "embeddings"), "vec_id").select("token", F.col("embedding").alias("vec")))
    texts = table(s, d, "ingredient_texts").where("text is not null").select(F.lower("text").alias("t")).distinct()
    tokens = F.regexp_extract_all("t", F.lit(r"\p{L}+"), F.lit(0))
    names = texts.select(F.col("t").alias("qid"), catalogue.content_tokens(tokens, catalogue.stems(tokens)).alias("tokens"))
    return catalogue.match(names, foods, vectors, catalogue.override_table(s))


@query("""SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def events_by_type(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("user_id").alias("users"))


@query("SELECT k, count(*) AS n_rows FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def json_keys(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    keys = e.select(F.explode(F.json_object_keys("props")).alias("k"))
    return keys.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"))

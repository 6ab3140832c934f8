"""One consistent form for text that looks the same.

1. Character variants: width and style variants, ligatures, Roman numeral
   letters and spaces of other widths become the plain character; invisible
   characters go; accents are composed.  The table comes from the Unicode
   database by decomposition tag, so fractions, superscripts and circled
   forms, which look different, stay.
2. Look-alike letters, script-aware: in a token of mixed script (or one that
   is wholly foreign to its sentence), the letters outside the dominant
   script are replaced by their look-alikes, if the result is a token of the
   corpus vocabulary.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import blank, expand, key128, ordered, rows_of
from quern.runtime import bucket_pairs, lookup, materialise

# Letters that look like Latin ones; fixed values.
LOOKALIKES = {
    "CYRILLIC": dict(zip("аеорсухѕіјһԁԛԝѵӏАВЕЅІЈКМНОРСТУХԚԜҮ", "aeopcyxsijhdqwvlABESIJKMHOPCTYXQWY")),
    "GREEK": dict(zip("ονικαρυχγΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ", "ovikapuxyABEZHIKMNOPTYXcj")),
    "IPA": dict(zip("ɑɡıɩ", "agii")),
    "ARMENIAN": dict(zip("օսհոցյզՏԼՕ", "ouhngjqSLO")),
    "CHEROKEE": dict(zip("ᎪᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏔᏃᏟᎠᏴᏀᏙ", "AEHJKLMPRSTWZCDBGV")),
}
_TO_LATIN = {c: (s, l) for s, m in LOOKALIKES.items() for c, l in m.items()}
_FROM_LATIN = {s: {l: c for c, l in m.items()} for s, m in LOOKALIKES.items() if s in ("CYRILLIC", "GREEK")}
_SHARED = {l for _, l in _TO_LATIN.values()}
_SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
# Characters without a look of their own; fixed values.
_INVISIBLE = re.compile("[\u00ad\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\U000e0000-\U000e0fff]")
_TOKEN = re.compile(r"[^\W_]+")
_PLAIN = "^[\\x09-\\x7e]*$"


def _fold_char(ch: str) -> str:
    """The plain character(s) behind a variant that looks the same."""
    if ch in "‐‑":
        return "-"
    parts = unicodedata.decomposition(ch).split()
    if not parts or parts[0] not in _SAME_LOOK:
        return ch
    plain = "".join(_fold_char(chr(int(x, 16))) for x in parts[1:])
    # Spacing accents decompose into a space and a mark, which is another look.
    return plain if plain == " " or not plain.startswith(" ") else ch


class _Folds(dict):
    def __missing__(self, code: int) -> str:
        self[code] = out = _fold_char(chr(code))
        return out


_FOLDS = _Folds()


def fold(text: str) -> str:
    """Step 1 on one string."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", _INVISIBLE.sub("", text).translate(_FOLDS))


def script(ch: str) -> str:
    """The script of a letter; '' for what has none."""
    if ch in _TO_LATIN:
        return _TO_LATIN[ch][0]
    if ch.isascii():
        return "LATIN" if ch.isalpha() else ""
    return unicodedata.name(ch, "").split(" ")[0] if ch.isalpha() else ""


def _dominant(text: str, scripts: list[str]) -> str:
    """The script with most letters that belong to it alone; then with most letters."""
    firm: dict[str, tuple[int, int]] = {}
    for c, s in zip(text, scripts):
        if s:
            a, b = firm.get(s, (0, 0))
            firm[s] = (a + (c not in _TO_LATIN and c not in _SHARED), b + 1)
    return max(firm, key=lambda s: (firm[s], s)) if firm else ""


def proposals(folded: str) -> list[tuple[str, str, bool]]:
    """Step 2's candidates in one folded string: ``(token, repaired)`` and whether the token is of mixed script."""
    if folded.isascii():
        return []
    tokens = [(t, [script(c) for c in t]) for t in _TOKEN.findall(folded)]
    main = _dominant("".join(t for t, _ in tokens), [s for _, x in tokens for s in x])
    if not main:
        return []
    out = set()
    for t, scripts in tokens:
        own = {s for s in scripts if s}
        if not own - {"LATIN"} or (len(own) == 1 and main in own):
            continue
        # Latin first where the token has any Latin or stands in a Latin sentence, then the token's own majority.
        most = _dominant(t, scripts)
        for target in dict.fromkeys(["LATIN" if "LATIN" in own or main == "LATIN" else most, most]):
            to = "".join(c if s in ("", target) else _swap(c, s, target) for c, s in zip(t, scripts))
            if to != t and "\0" not in to:
                out.add((t, to, len(own) > 1))
    return sorted(out)


def _swap(c: str, own: str, target: str) -> str:
    latin = c if own == "LATIN" else _TO_LATIN.get(c, ("", "\0"))[1]
    return latin if target == "LATIN" else _FROM_LATIN.get(target, {}).get(latin, "\0")


_TRY = T.StructType().add("token", T.StringType()).add("repaired", T.StringType()).add("mixed", T.BooleanType())


@F.pandas_udf(T.StructType().add("folded", T.StringType()).add("tries", T.ArrayType(_TRY)))
def _folded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        done = [fold(t) for t in texts]
        tries = [[{"token": a, "repaired": b, "mixed": m} for a, b, m in proposals(t)] for t in done]
        yield pd.DataFrame({"folded": done, "tries": tries})


@F.pandas_udf(T.StringType())
def _replaced(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, fixes in batches:
        out = []
        for text, fix in zip(texts, fixes):
            to = {x["token"]: x["repaired"] for x in fix}
            out.append(_TOKEN.sub(lambda m, to=to: to.get(m[0], m[0]), text))
        yield pd.Series(out)


def row_forms(rows: DataFrame, strict: bool = False) -> DataFrame:
    """``rows`` (``id``, ``text`` and other columns) with ``form``, the consistent form of the text.

    Rows of plain characters are their own form; only the others are looked
    at, each distinct text once.  ``strict`` keeps to the named method: only
    tokens of mixed script, and only results that the corpus has.
    """
    rows = rows.where("text is not null").withColumn("_plain", F.col("text").rlike(_PLAIN))
    plain = rows.where("_plain").drop("_plain").withColumn("form", F.col("text"))
    others = rows.where("not _plain").drop("_plain")
    odd = others.groupBy("text").agg(F.min("id").alias("sid"), F.count(F.lit(1)).alias("n"))
    odd = materialise(odd.withColumn("_f", _folded("text")).select("sid", "text", "n", "_f.folded", "_f.tries"))
    tries = odd.select("sid", F.explode("tries").alias("_t")).select("sid", "_t.*")
    if strict:
        tries = tries.where("mixed")
    spelled = materialise(tries.groupBy("token", "repaired").agg(F.count(F.lit(1)).alias("uses")))
    # A result is attested if the corpus has it as a token, or if two spellings lead to it.
    token = F.explode(F.array_distinct(F.regexp_extract_all("form", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
    words = plain.select(token.alias("repaired")).unionByName(odd.select(F.col("folded").alias("form")).select(token.alias("repaired")))
    attested = words.join(spelled.select("repaired").distinct(), "repaired", "left_semi").distinct()
    if not strict:
        twice = spelled.groupBy("repaired").agg(F.countDistinct("token").alias("k")).where("k > 1").select("repaired")
        attested = attested.unionByName(twice).distinct()
    known = spelled.join(attested, "repaired", "left_semi")
    # A token with two attested results takes the Latin one, then the smaller.
    rank = F.struct(F.col("repaired").rlike("^[\\x00-\\x{24f}]*$").cast("int"), "repaired")
    known = known.groupBy("token").agg(F.max_by("repaired", rank).alias("fix"), F.sum("uses").alias("uses"))
    fixes = lookup(tries.select("sid", "token").distinct(), known, "token", "uses", F.xxhash64("sid"), how="inner")
    fixes = fixes.groupBy("sid").agg(F.collect_list(F.struct("token", F.col("fix").alias("repaired"))).alias("fixes"))
    done = odd.select("sid", "text", "n", "folded").join(fixes, "sid", "left")
    some = done.where("fixes is not null").select("text", _replaced("folded", "fixes").alias("form"), "n")
    none = done.where("fixes is null").select("text", F.col("folded").alias("form"), "n")
    return plain.unionByName(lookup(others, some.unionByName(none), "text", "n", F.xxhash64("id"), how="inner"))


def consistent(df: DataFrame, id_col: str = "id", text_col: str = "sentence", strict: bool = False) -> DataFrame:
    """Every row's consistent form: ``id, text, form``.

    Null gives null, empty and blank text keep their spaces as plain ones.
    Equal texts get equal forms; a row that is there twice comes out twice.
    Text of any length is handled whole.
    """
    rows = rows_of(df, id_col, text_col)
    empty = rows.where("text is null").withColumn("form", F.lit(None).cast("string"))
    return row_forms(rows, strict).select("id", "text", "form").unionByName(empty)


def found(df: DataFrame, id_col: str = "id", text_col: str = "sentence", strict: bool = False) -> DataFrame:
    """``id_a, id_b``: rows with different strings of one form."""
    rows = rows_of(df, id_col, text_col).where(~blank(F.col("text")))
    keyed = materialise(row_forms(rows, strict).select("id", key128(F.col("text")).alias("text"), key128(F.col("form")).alias("form")))
    # Few forms have more than one string; only those are looked at further.
    shared = keyed.groupBy("form").agg(F.min("text").alias("_a"), F.max("text").alias("_b"), F.count(F.lit(1)).alias("n")).where("_a <> _b")
    used = materialise(lookup(keyed, shared.select("form", "n", F.lit(True).alias("used")), "form", "n", F.xxhash64("id"), how="inner"))
    texts = used.select("form", F.col("text").alias("sid")).distinct()
    pairs = bucket_pairs(texts, "form").select(F.col("sid_a").alias("u"), F.col("sid_b").alias("v"))
    return ordered(expand(pairs, used.select(F.col("text").alias("u"), "id")))

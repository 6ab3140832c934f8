"""Text decoded with the wrong character encoding: found and restored.

A noisy-channel decoder.  Under each single-byte codec the characters of a
chunk with suspicious characters are bytes again, and runs of bytes that form
one UTF-8 character are that character.  A chunk without lost bytes is
decoded run by run: UTF-8 synchronises itself, so one codec and layer give
one path, and paths of all codecs and up to three layers compete.  Their
score is the frequency of their words in the sound part of the corpus, plus a
channel cost for layers and for characters that vanish.

A chunk with lost bytes (replacement characters) is a lattice of words: its
stretches stand for themselves, for a reading that the corpus has, or, with a
lost byte, for any corpus word whose characters garbled by up to three layers
agree with all kept characters; there a lost byte is any one character.  The
Viterbi path over these words is taken.  A lost byte in no corpus word stays.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import blank
from quern.runtime import lookup, materialise

# Codecs by which UTF-8 bytes are often read; fixed values.
CODECS = ("cp1252", "latin-1", "cp1251", "cp1250", "iso8859-2", "cp437", "cp850", "mac_roman")
LAYERS = 3
#: Nats for a layer of decoding and for each character that a decoding saves.
LAYER_COST, SAVED_GAIN = 1.0, 5.0
#: A path must beat the text as it stands by so many nats.
MARGIN = 3.0

_CHUNK = re.compile("[0-9A-Za-z\\x80-\U0010ffff]*[\\x80-\U0010ffff][0-9A-Za-z\\x80-\U0010ffff]*")
_WORD = re.compile(r"[^\W_]+")
#: Words, and every other character beyond ASCII by itself.
_TOKEN = re.compile(r"[^\W_]+|[^\x00-\x7f]")
_LOST = "�"


def _byte(ch: str, codec: str, cache: dict[tuple[str, str], int]) -> int:
    """The byte behind a character under a codec, -1 if none."""
    key = (ch, codec)
    if key not in cache:
        try:
            cache[key] = ch.encode(codec)[0]
        except UnicodeEncodeError:
            # Bytes that the codec leaves undefined often pass as control characters.
            cache[key] = ord(ch) if 0x80 <= ord(ch) <= 0x9F else -1
    return cache[key]


def _decode(chunk: str, codec: str, cache: dict[tuple[str, str], int]) -> str:
    """The Viterbi path of one layer: every complete UTF-8 sequence becomes its character."""
    out, i, n = [], 0, len(chunk)
    while i < n:
        ch = chunk[i]
        size = 0
        if ch >= "\x80":
            lead = _byte(ch, codec, cache)
            size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        if size and i + size <= n:
            raw = [_byte(x, codec, cache) if x >= "\x80" else -1 for x in chunk[i : i + size]]
            if all(0x80 <= b <= 0xBF for b in raw[1:]):
                try:
                    out.append(bytes(raw).decode("utf-8"))
                    i += size
                    continue
                except UnicodeDecodeError:
                    pass
        out.append(ch)
        i += 1
    return "".join(out)


def _control(chunk: str) -> str:
    """Control characters that are Windows punctuation read as Latin-1."""
    out = []
    for c in chunk:
        if "\x80" <= c <= "\x9f" and c != "\x85":
            try:
                c = c.encode("latin-1").decode("cp1252")
            except UnicodeDecodeError:
                pass
        out.append(c)
    return "".join(out)


def paths(chunk: str, cache: dict[tuple[str, str], int]) -> dict[str, int]:
    """All other readings of a chunk, with the layers they take."""
    found: dict[str, int] = {}
    front = [chunk]
    for layer in range(1, LAYERS + 1):
        new = []
        for text in front:
            for reading in [*(_decode(text, c, cache) for c in CODECS), _control(text)]:
                if reading != text and reading not in found and reading != chunk:
                    found[reading] = layer
                    new.append(reading)
        front = new
    return found


def _latin(c: str) -> bool:
    return unicodedata.name(c, "").startswith("LATIN")


def _plausible(old: str, new: str) -> tuple[list[str], list[str]]:
    """Words of the reading, and the words and characters among them that the
    sound part of the corpus must have: words with a restored letter that are
    not wholly Latin, and restored rare letters, marks, numerals and symbols."""
    fresh = set(new) - set(old)
    words = _WORD.findall(new)
    must = [w for w in words if any(c in fresh and c.isalpha() for c in w) and not all(_latin(c) for c in w if c.isalpha())]
    # Letters beyond the accented ones of common languages are mostly chance readings of two sound characters.
    must += [c for c in sorted(fresh) if c.isalpha() and _latin(c) and c > "\u017f"]
    return words, must + [c for c in sorted(fresh) if not c.isalpha() and unicodedata.category(c)[0] in "MNSC" and unicodedata.category(c) not in ("Sc", "Sk")]


_PATH = T.StructType([
    T.StructField("old", T.StringType()), T.StructField("new", T.StringType()), T.StructField("gain", T.DoubleType()),
    T.StructField("words", T.ArrayType(T.StringType())), T.StructField("less", T.ArrayType(T.StringType())), T.StructField("must", T.IntegerType()),
])
_LATTICE = T.StructType([T.StructField("lost", T.BooleanType()), T.StructField("paths", T.ArrayType(_PATH)), T.StructField("holes", T.ArrayType(T.StringType()))])


@F.pandas_udf(_LATTICE)
def _lattice(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    cache: dict[tuple[str, str], int] = {}
    for texts in batches:
        lost, all_paths, holes = [], [], []
        for text in texts:
            mine, gaps = {}, set()
            for chunk in set(_CHUNK.findall(text)):
                if _LOST in chunk:
                    gaps.add(chunk)
                before = _TOKEN.findall(chunk)
                for new, layers in paths(chunk, cache).items():
                    words, must = _plausible(chunk, new)
                    if any("\x80" <= c <= "\x9f" for c in new):
                        continue
                    gain = SAVED_GAIN * (len(chunk) - len(new)) - LAYER_COST * layers
                    mine[chunk, new] = {"old": chunk, "new": new, "gain": gain, "words": words, "less": before, "must": len(must)}
                    if must:
                        mine[chunk, new]["words"] = must + words
            lost.append(_LOST in text)
            all_paths.append(list(mine.values()))
            holes.append(sorted(gaps))
        yield pd.DataFrame({"lost": lost, "paths": all_paths, "holes": holes})


# -- lost bytes ----------------------------------------------------------------


def _read(b: int, codec: str) -> str:
    """The character that a byte is read as; undefined bytes pass as control characters."""
    try:
        return bytes([b]).decode(codec)
    except UnicodeDecodeError:
        return chr(b)


def _forms(ch: str, cache: dict[str, dict[str, int]]) -> dict[str, int]:
    """What a character can look like, with the layers that it takes."""
    if ch not in cache:
        forms, front = {ch: 0}, [ch] if ch >= "\x80" else []
        if front and _control(x := ch.encode("cp1252", "ignore").decode("latin-1")) == ch != x:
            forms[x] = 1
        for layer in range(1, LAYERS + 1):
            new = {"".join(_read(b, c) if b >= 0x80 else chr(b) for b in text.encode()) for text in front for c in CODECS}
            front = sorted(new - set(forms))
            forms |= dict.fromkeys(front, layer)
        cache[ch] = forms
    return cache[ch]


def _layers(part: str, word: str, cache: dict[str, dict[str, int]]) -> int | None:
    """The least layers by which the word can look like the part, in which a lost byte is any character."""
    best = {0: 0}
    for ch in word:
        new: dict[int, int] = {}
        for at, most in best.items():
            for form, layers in _forms(ch, cache).items():
                end = at + len(form)
                if end <= len(part) and all(p == f or p == _LOST and f >= "\x80" for p, f in zip(part[at:end], form)):
                    new[end] = min(new.get(end, LAYERS + 1), max(most, layers))
        best = new
    return best.get(len(part))


def _classes(text: str, codec: str, cache: dict[tuple[str, str], int]) -> str:
    """Per character: c for a continuation byte, 2 to 4 for the lead of so many bytes, else x."""
    kind = lambda b: "c" if 0x80 <= b <= 0xBF else "2" if 0xC2 <= b <= 0xDF else "3" if 0xE0 <= b <= 0xEF else "4" if 0xF0 <= b <= 0xF4 else "x"
    return "".join(kind(_byte(c, codec, cache)) if c >= "\x80" else "x" for c in text)


_BEFORE, _AFTER = re.compile("(?:2c|3cc|4ccc)*(?:2|3c?|4c{0,2})?"), re.compile("c{0,3}(?:2c|3cc|4ccc)*")


def _ends(text: str, tail: bool, cache: dict[tuple[str, str], int]) -> set[tuple[str, int]]:
    """Readings of the kept end of a part, without the characters that may belong to a lost byte, and how many those are."""
    out = set()
    for k in range(len(text) + 1):
        gone, kept = (text[:k], text[k:]) if tail else (text[len(text) - k :], text[: len(text) - k])
        if not any((_AFTER if tail else _BEFORE).fullmatch(_classes(gone, c, cache)) for c in CODECS):
            continue
        out |= {(x, k) for x in [kept, *paths(kept, cache)] if not x or x.isalnum()}
    return out


def _stretches(chunk: str) -> list[int]:
    """Places where a word may start or end: before and after what is neither letter, digit nor lost."""
    return sorted({0, len(chunk), *(k for i, c in enumerate(chunk) if c != _LOST and not c.isalnum() for k in (i, i + 1))})


def _structs(**kinds: str) -> T.ArrayType:
    of = {"int": T.IntegerType(), "string": T.StringType()}
    return T.ArrayType(T.StructType([T.StructField(k, of[v]) for k, v in kinds.items()]))


_ARCS = T.StructType([
    T.StructField("plain", _structs(start="int", end="int", word="string", layers="int")),
    T.StructField("wild", _structs(start="int", end="int", part="string", head="string", n="int", tail="string")),
])


@F.pandas_udf(_ARCS)
def _arcs(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Arcs of a chunk with lost bytes: known readings, and where a corpus word of which the middle is not known may stand."""
    cache: dict[tuple[str, str], int] = {}
    for chunks in batches:
        plain, wild = [], []
        for chunk in chunks:
            at = _stretches(chunk)
            own = {(i, j, chunk[i:j], 0) for i, j in zip(at, at[1:])}
            open_ = set()
            for x, i in enumerate(at):
                for j in at[x + 1 :]:
                    part = chunk[i:j]
                    if _LOST not in part:
                        own |= {(i, j, new, layers) for new, layers in paths(part, cache).items() if _TOKEN.fullmatch(new)}
                    elif part.strip(_LOST):
                        first, last = part.index(_LOST), part.rindex(_LOST) + 1
                        for head, k in _ends(part[:first], False, cache):
                            for tail, m in _ends(part[last:], True, cache):
                                open_ |= {(i, j, part, head, n, tail) for n in range(1, last - first + k + m + 1)}
            plain.append([dict(zip(("start", "end", "word", "layers"), x)) for x in sorted(own)])
            wild.append([dict(zip(("start", "end", "part", "head", "n", "tail"), x)) for x in sorted(open_)])
        yield pd.DataFrame({"plain": plain, "wild": wild})


@F.pandas_udf(_structs(head="string", n="int", tail="string"))
def _middles(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A word without each middle that starts and ends beyond ASCII and has at most so many characters."""
    for words, most in batches:
        out = []
        for word, size in zip(words, most):
            at = [i for i, c in enumerate(word) if c >= "\x80"]
            out.append([{"head": word[:i], "n": j + 1 - i, "tail": word[j + 1 :]} for i in at for j in at if i <= j < i + size])
        yield pd.Series(out)


@F.pandas_udf(T.IntegerType())
def _agreeing(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    cache: dict[str, dict[str, int]] = {}
    for parts, words in batches:
        yield pd.Series([_layers(p, w, cache) for p, w in zip(parts, words)], dtype="Int32")


def best_path(chunk: str, arcs: list[tuple[int, int, str, float]]) -> str:
    """The text of the best path over ``start, end, word, score``; ties go to the greater text."""
    best: dict[int, tuple[float, str]] = {0: (0.0, "")}
    for start, end, word, score in sorted(arcs):
        if start in best:
            way = (best[start][0] + score, best[start][1] + word)
            best[end] = max(best.get(end, way), way)
    return best[len(chunk)][1]


@F.pandas_udf(T.StringType())
def _viterbi(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for chunks, arcs in batches:
        yield pd.Series([best_path(c, [(x["start"], x["end"], x["word"], x["score"]) for x in a]) for c, a in zip(chunks, arcs)])


def _filled(holes: DataFrame, vocabulary: DataFrame, total: float) -> DataFrame:
    """``old, new`` of the chunks with lost bytes (``old``) that the Viterbi path changes."""
    arcs = materialise(holes.select("old", _arcs("old").alias("_a")).select("old", "_a.*"))
    plain = arcs.select("old", F.explode("plain").alias("_p")).select("old", "_p.*")
    wild = materialise(arcs.select("old", F.explode("wild").alias("_w")).select("old", "_w.*"))
    bound = wild.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max(F.length("part")), F.lit(0)).alias("part")).first()
    count = F.when(F.col("word").rlike(r"^[\p{L}\p{N}]+$"), F.col("alone")).otherwise(F.col("count"))
    vocabulary = vocabulary.select("word", count.alias("count")).where("count > 0")
    words = vocabulary.where(F.col("word").rlike(r"^[\p{L}\p{N}]*[^\x00-\x7f][\p{L}\p{N}]*$") & (F.length("word") <= bound["part"]))
    keyed = words.select("word", "count", F.explode(_middles("word", F.lit(bound["n"]))).alias("_m")).select("word", "count", "_m.*")
    # A character beyond ASCII never looks like one within, so the ASCII characters of part and word are the same.
    ascii_ = lambda c: F.regexp_replace(c, r"[^\x00-\x7f]", "")
    wild, keyed = wild.withColumn("ascii", ascii_("part")), keyed.withColumn("ascii", ascii_("word"))
    met = wild.join(keyed, ["head", "n", "tail", "ascii"]).select("old", "start", "end", "part", "word", "count").distinct()
    met = met.withColumn("layers", _agreeing("part", "word")).where("layers is not null").drop("part")
    known = plain.join(vocabulary, "word", "left").where("layers = 0 or count is not null").select(*met.columns)
    score = F.log((F.coalesce("count", F.lit(0)) + 0.01) / F.lit(float(total))) - LAYER_COST * F.col("layers")
    scored = known.unionByName(met).select("old", F.struct("start", "end", "word", score.alias("score")).alias("arc"))
    return scored.groupBy("old").agg(F.collect_list("arc").alias("arcs")).select("old", _viterbi("old", "arcs").alias("new")).where("new <> old")


@F.pandas_udf(T.StringType())
def _applied(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, fixes in batches:
        out = []
        for text, fix in zip(texts, fixes):
            to = {x["old"]: x["new"] for x in fix}
            out.append(_CHUNK.sub(lambda m, to=to: to.get(m[0], m[0]), text))
        yield pd.Series(out)


def repaired(df: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("sentence", "source")) -> DataFrame:
    """``id, field_name, value, restored, complete``: one row per affected field.

    ``restored`` is the value with all restorable spans restored; it is null
    where nothing could be restored, and ``complete`` tells whether nothing
    damaged is left.  Null and blank values are never affected.  A row that
    is there twice comes out twice; other columns are ignored.
    """
    names = F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f).cast("string") for f in fields])))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), names.alias("field_name", "value")).where(~blank(F.col("value")))
    values = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    values = materialise(values.withColumn("odd", F.col("value").rlike("[^\\x00-\\x7f]")))
    odd = materialise(values.where("odd").select("value", "n", _lattice("value").alias("_l")).select("value", "n", "_l.*"))
    # Word frequencies over the sound values: those without lost bytes and without another reading.
    as_ = lambda k: lambda w: F.struct(w.alias("word"), F.lit(k).alias("k"))
    tokens = [F.transform(F.regexp_extract_all("value", F.lit(x), F.lit(0)), as_(k)) for k, x in ((1, r"[\p{L}\p{N}]+"), (0, r"[^\x00-\x7f]"))]
    sound = values.where("not odd").select("value", "n").unionByName(odd.where("not lost and size(paths) = 0").select("value", "n"))
    # ``alone``: as a word, not as a character of one.
    vocabulary = sound.select("n", F.explode(F.concat(*tokens)).alias("_t")).groupBy("_t.word").agg(F.sum("n").alias("count"), F.sum(F.col("n") * F.col("_t.k")).alias("alone"))
    vocabulary = materialise(vocabulary)
    total = vocabulary.agg(F.coalesce(F.sum("count"), F.lit(0)) + 1.0).first()[0]

    ways = odd.select(F.explode("paths").alias("_p")).select("_p.*").groupBy("old", "new", "gain", "words", "less", "must").agg(F.count(F.lit(1)).alias("_"))
    said = ways.select("old", "new", "must", F.posexplode("words").alias("at", "word"))
    said = said.select("old", "new", "word", (F.col("at") >= F.col("must")).cast("int").alias("sign"), (F.col("at") < F.col("must")).alias("needed"))
    less = ways.select("old", "new", F.explode("less").alias("word"), F.lit(-1).alias("sign"), F.lit(False).alias("needed"))
    worth = F.log((F.coalesce("count", F.lit(0)) + 0.01) / F.lit(float(total)))
    scored = said.unionByName(less).join(vocabulary, "word", "left").groupBy("old", "new").agg(
        F.sum(F.col("sign") * worth).alias("words_gain"), F.max(F.col("needed") & F.col("count").isNull()).alias("unmet")
    )
    ranked = ways.join(scored, ["old", "new"], "left").where("not coalesce(unmet, false)")
    ranked = ranked.withColumn("score", F.col("gain") + F.coalesce("words_gain", F.lit(0.0))).where(F.col("score") > MARGIN)
    best = ranked.groupBy("old").agg(F.max_by("new", F.struct("score", "new")).alias("new"))

    hole = odd.select(F.explode("holes").alias("old")).distinct()
    filled = materialise(_filled(hole, vocabulary, total))

    fixes = filled.unionByName(best.join(filled, "old", "left_anti"))
    used = odd.select("value", "n", F.explode(F.array_union("holes", F.transform("paths", lambda p: p["old"]))).alias("old"))
    uses = used.groupBy("old").agg(F.count(F.lit(1)).alias("uses"))
    fixes = materialise(fixes.join(uses, "old"))
    per_value = lookup(used, fixes, "old", "uses", F.xxhash64("value"), how="inner")
    per_value = per_value.groupBy("value").agg(F.collect_list(F.struct("old", "new")).alias("fixes"))
    done = odd.select("value", "n", "lost").join(per_value, "value", "left").where("lost or fixes is not null")
    some = done.where("fixes is not null").select("value", "n", _applied("value", "fixes").alias("restored"))
    none = done.where("fixes is null").select("value", "n", F.lit(None).cast("string").alias("restored"))
    affected = some.unionByName(none).withColumn("complete", F.coalesce(~F.col("restored").contains(_LOST), F.lit(False)))
    return lookup(rows, materialise(affected), "value", "n", F.xxhash64("id"), how="inner").select("id", "field_name", "value", "restored", "complete")


def found(df: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("sentence", "source")) -> DataFrame:
    """``id, field_name`` of every affected field."""
    return repaired(df, id_col, fields).select("id", "field_name").distinct()

"""Tokens and what can be told of a single token, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import vocab
from quern.functions.porter import stem as _stem

_MARKS = r"()\[\]{},/:;?!*~"
_FRACTION = r"\d*#\d+\$\d+(?:-\d*#\d+\$\d+)?"
# Digits may be grouped by single underscores, as in number literals.
_DIGITS = r"\d(?:_?\d)*"
_FLOAT = rf"[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"


def tokenise(c: Column) -> Column:
    """Tokens of a sentence: runs without white space, marks by themselves,
    ``and/or`` in one piece, a final full stop cut off unless it ends an
    abbreviation.  Null gives null, blank text an empty array."""
    pieces = F.transform(F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0)), lambda t: F.regexp_extract_all(t, F.lit(rf"[{_MARKS}]|[^{_MARKS}]+"), F.lit(0)))
    joined = F.concat(F.lit("\x01"), F.array_join(F.flatten(pieces), "\x01"), F.lit("\x01"))
    joined = F.replace(joined, F.lit("\x01and\x01/\x01or\x01"), F.lit("\x01and/or\x01"))
    # The stop is a token of its own if no dot and single word character stand before it.
    joined = F.regexp_replace(joined, "(?<!\x01)(?<!\\.\\w)\\.\x01", "\x01.\x01")
    return F.filter(F.split(joined, "\x01"), lambda t: t != "")


def is_numeric(c: Column) -> Column:
    """Numbers, fractions, ranges, multipliers and number words.  ``nan`` and
    ``inf`` are no numbers here."""
    words = "|".join(vocab.STRING_NUMBERS)
    one = rf"(?!00$)(?:{_FRACTION}|(?i:{words})|dozen|{_FLOAT}x?)"
    return c.rlike(rf"^{one}$") | (c.contains("-") & F.forall(F.split(c, "-"), lambda p: p.rlike(rf"^{one}$")))


def is_float(c: Column) -> Column:
    """A plain number literal."""
    return c.rlike(rf"^{_FLOAT}$")


def is_range(c: Column) -> Column:
    """Two whole numbers or fractions with a hyphen; decimals are no range."""
    return c.rlike(r"^[\d#$]+\s*-[\d#$]+$")


def is_unit(c: Column) -> Column:
    return F.lower(c).isin(sorted({*vocab.UNITS.values()}))


def is_ambiguous_unit(c: Column) -> Column:
    return c.isin(vocab.AMBIGUOUS)


def is_punctuation(c: Column) -> Column:
    """A run of neighbouring ASCII marks, or ``--``; also the empty token."""
    return F.lit(vocab.PUNCTUATION).contains(c) | (c == "--")


def is_capitalised(c: Column) -> Column:
    return c.rlike("^[A-Z]")


def without_accents(c: Column) -> Column:
    """Letters of the Latin, Greek and Cyrillic blocks without their accents, and no combining marks."""
    import unicodedata

    pairs = [(chr(x), unicodedata.normalize("NFD", chr(x))) for x in (*range(0xC0, 0x530), *range(0x1E00, 0x2000))]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1]
    c = F.translate(c, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    return F.regexp_replace(c, r"\p{Mn}+", "")


def word_shape(c: Column) -> Column:
    """``Xxxx`` for words, ``d`` for digits, accents ignored."""
    c = without_accents(c)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "x"), "[A-Z]", "X"), "[0-9]", "d")


def affix(c: Column, n: int, end: bool) -> Column:
    """Prefix or suffix of n characters if the token has more; none for numbers."""
    cut = F.right(c, F.lit(n)) if end else F.left(c, F.lit(n))
    return F.when((F.length(c) > n) & (c != "!num"), cut)


def length_bucket(n: Column) -> Column:
    """The largest of 1, 2, 4, 8, 12, 16, 20, 32, 64 that is not above n, at least 1."""
    return F.coalesce(F.array_max(F.filter(F.array(*[F.lit(x) for x in (1, 2, 4, 8, 12, 16, 20, 32, 64)]), lambda b: b <= n)), F.lit(1))


@F.pandas_udf(T.StringType())
def _stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str] = {}
    for s in batches:
        out = []
        for w in s:
            if w not in known:
                if len(known) > 200_000:
                    known.clear()
                known[w] = _stem(w) if w is not None else None
            out.append(known[w])
        yield pd.Series(out)


def stem(c: Column) -> Column:
    """Porter stem in lower case; Arrow batches with a bounded memory of words."""
    return _stems(c)


def sublist_index(tokens: Column, wanted: list[str], whole_words: bool = True, any_case: bool = True) -> Column:
    """Place of the first run of ``wanted`` among ``tokens`` (from 0), -1 if none or if nothing is wanted."""
    n = len(wanted)
    if not n:
        return F.lit(-1)
    cased = F.lower if any_case else (lambda x: x)
    find = [w.lower() if any_case else w for w in wanted]

    def fits(at: Column) -> Column:
        ok = F.lit(True)
        for k, w in enumerate(find):
            t = cased(F.get(tokens, at + k))
            ok = ok & (t == w if whole_words else t.contains(w))
        return ok

    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0))), fits)
    return F.coalesce(F.array_min(F.when(F.size(tokens) >= n, places)), F.lit(-1)).cast("int")


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th ..."""
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def labelled(tokens: Column, labels: Column, label: str) -> Column:
    """The tokens of one label joined by spaces; ``NAME`` stands for all name labels."""
    fits = (lambda x: x["l"].contains("NAME")) if label == "NAME" else (lambda x: x["l"] == label)
    pairs = F.arrays_zip(tokens.alias("t"), labels.alias("l"))
    return F.array_join(F.transform(F.filter(pairs, fits), lambda x: x["t"]), " ")

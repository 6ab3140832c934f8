"""Sentence normalisation as Column expressions, one function per step.

Each takes and gives a string Column; null gives null and text of any length
is handled whole.  ``normalise`` applies all steps in their order.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import vocab



def any_of(words: list[str]) -> str:
    """A pattern for any of the words, longest first, with common beginnings
    tried once: a long plain alternation costs its length at every character."""
    tree: dict = {}
    for w in sorted(set(words)):
        at = tree
        for ch in w:
            at = at.setdefault(ch, {})
        at[""] = {}

    def pattern(node: dict) -> str:
        ways = [re.escape(ch) + pattern(nxt) for ch, nxt in sorted(node.items()) if ch]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return body + "?" if "" in node else body

    return pattern(tree)


_UNITS = any_of([*vocab.UNIT_FORMS, "in", "x"])
_KNOWN = any_of(vocab.UNIT_FORMS)
_NUMBER = r"[\d.]+|\d*#\d+\$\d+"
_RANGE_END = r"0\.[0-9]{}|[1-9][\d.]*?|\d*#\d+\$\d+"


def drop_prices(c: Column) -> Column:
    """``($0.20)`` and the like go."""
    return F.regexp_replace(c, r"\(\s*[$£€¥₹]\s*[0-9.,]+\**\s*\)", "")


def plain_dashes(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("–"), F.lit("-")), F.lit("—"), F.lit(" - "))


@F.pandas_udf(T.StringType())
def _unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: html.unescape(x) if x is not None and "&" in x else x)


def unescape_html(c: Column) -> Column:
    """All named and numeric entities; Arrow batches, since Spark has no such function."""
    return _unescape(c)


# Named fractions that recipes use as entities; fixed values.
_NAMED = {"frac12": "½", "frac14": "¼", "frac34": "¾", "frac13": "⅓", "frac23": "⅔", "frac18": "⅛", "frac38": "⅜", "frac58": "⅝", "frac78": "⅞"}


def unescape_fractions(c: Column) -> Column:
    """The entities of common fractions and ``&amp;`` only, without Python."""
    for name, sign in _NAMED.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(sign))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def ascii_fractions(c: Column) -> Column:
    """Fraction signs as `` n/d``; after a hyphen without the space."""
    signs = "".join(vocab.FRACTION_SIGNS)
    c = F.regexp_replace(c, rf"(?<!-)([{signs}])", " $1")
    for sign, text in vocab.FRACTION_SIGNS.items():
        c = F.replace(c, F.lit(sign), F.lit(text))
    return c


def join_and_fractions(c: Column) -> Column:
    """``1 and 1/2`` as ``1#1$2``."""
    return F.regexp_replace(c, r"(\d+)\sand\s(\d)/(\d+)", r"$1#$2\$$3")


def mark_fractions(c: Column) -> Column:
    """``2 3/4`` as ``2#3$4`` and ``1/2`` as ``#1$2``, so that no later step splits them."""
    c = F.replace(c, F.lit("⁄"), F.lit("/"))
    c = F.regexp_replace(c, r"(\d+)\s+(\d)/(\d+)", r"$1#$2\$$3")
    return F.regexp_replace(c, r"(\d+)/(\d+)", r"#$1\$$2")


def split_units(c: Column) -> Column:
    """Spaces between quantities and units that touch."""
    c = F.regexp_replace(c, rf"(\d)-?({_UNITS})(?![a-wyzA-WYZ])", "$1 $2")
    c = F.regexp_replace(c, rf"({_UNITS})(\d)", "$1 $2")
    c = F.regexp_replace(c, rf"({_UNITS})-(\d)", "$1 - $2")
    words = "|".join(vocab.STRING_NUMBERS)
    return F.regexp_replace(c, rf"(?i)\b({words})\b-\b({_UNITS})\b", "$1 $2")


def drop_unit_periods(c: Column) -> Column:
    """``tsp.`` as ``tsp``."""
    return F.regexp_replace(c, r"([Tt]sps?|[Tt]bsps?|[Tt]bs?|[Ll]bs?|[Oo]z)\.", "$1")


def string_ranges(c: Column) -> Column:
    """``1 to 2`` and ``1- or 2-`` as ``1-2`` and ``1-2-``."""
    first, second = _RANGE_END.format(""), _RANGE_END.format("+")
    return F.regexp_replace(c, rf"({first})\s*(-)?\s*(to|or)\s*(-)*\s*(({second})(-)?)", "$1-$5")


def same_unit_ranges(c: Column) -> Column:
    """``5 oz - 8 ounce`` as ``5-8 oz``, if both are one unit or synonyms."""
    # Neither unit may go on as a longer word.
    stop = r"(?![a-zA-Z])"
    c = F.regexp_replace(c, rf"(?i)({_NUMBER})\s((?-i:{_KNOWN}))\s*(?:-|to|or)\s*({_NUMBER})\s\2{stop}", "$1-$3 $2")
    for group in vocab.SYNONYMS:
        forms = sorted({x for u in group for x in (u, vocab.PLURALS.get(u, u)) if x in vocab.UNIT_FORMS}, key=lambda u: (-len(u), u))
        any_ = "|".join(forms)
        c = F.regexp_replace(c, rf"({_NUMBER})\s({any_})\s*(?:-|to|or)\s*({_NUMBER})\s(?:{any_}){stop}", "$1-$3 $2")
    return c


def merge_times(c: Column) -> Column:
    """``8 x 450`` as ``8x 450``."""
    return F.regexp_replace(c, rf"({_NUMBER})\s[xX]\s*", "$1x ")


def collapse_ranges(c: Column) -> Column:
    """``8 - 10`` as ``8-10``."""
    return F.regexp_replace(c, r"(\d)\s*-\s*([\d#])", "$1-$2")


STEPS = [
    drop_prices, plain_dashes, unescape_html, ascii_fractions, join_and_fractions, mark_fractions, split_units, drop_unit_periods,
    string_ranges, same_unit_ranges, merge_times, collapse_ranges,
]


def normalise(c: Column, all_entities: bool = True) -> Column:
    """All steps in order, then trimmed.  Without ``all_entities`` the whole chain stays in the JVM."""
    for step in STEPS:
        if step is unescape_html and not all_entities:
            step = unescape_fractions
        c = step(c)
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def string_numbers(c: Column) -> Column:
    """Numbers in words as digits, whatever their case."""
    for word, digits in vocab.STRING_NUMBERS.items():
        c = F.regexp_replace(c, rf"(?i)\b{word}\b", digits)
    return c


def fix_punctuation(c: Column) -> Column:
    """No space inside brackets, around slashes and before marks."""
    c = F.replace(F.replace(F.replace(c, F.lit("( "), F.lit("(")), F.lit(" )"), F.lit(")")), F.lit(" / "), F.lit("/"))
    return F.trim(F.regexp_replace(c, r" ([,:;.!?*])", "$1"))


def singular_unit(c: Column) -> Column:
    """The singular of a unit token, other tokens unchanged."""
    table = F.create_map(*[F.lit(x) for p in vocab.UNITS.items() for x in p])
    return F.coalesce(F.try_element_at(table, c), c)


def plural_unit(c: Column) -> Column:
    """The plural of a unit token, other tokens unchanged."""
    table = F.create_map(*[F.lit(x) for p in vocab.PLURALS.items() for x in p])
    return F.coalesce(F.try_element_at(table, c), c)


def pluralise_units(c: Column) -> Column:
    """Every unit word of a text in its plural."""
    words = F.split(c, r"(?<=\b)|(?=\b)")
    return F.array_join(F.transform(words, plural_unit), "")


def unit_class(c: Column) -> Column:
    """A number for each set of synonymous units; null for other tokens."""
    table = F.create_map(*[F.lit(x) for n, g in enumerate(vocab.SYNONYMS) for u in g for x in (u, n)])
    return F.try_element_at(table, singular_unit(c))


def is_synonym(a: Column, b: Column) -> Column:
    """Whether two tokens are units of the same meaning."""
    both = a.isin(vocab.UNIT_FORMS) & b.isin(vocab.UNIT_FORMS)
    return F.coalesce(both & (unit_class(a) == unit_class(b)), F.lit(False))

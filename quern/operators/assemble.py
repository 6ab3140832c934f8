"""Records from labelled tokens.

A sentence's tokens, tags, labels and scores become one record: names, size,
amounts, preparation, comment and purpose.  The rules hand tokens on from
step to step (what an amount took is not there for the comment), so a
sentence is assembled as a whole in Arrow batches; there is no shuffle, and
the same function runs on streams.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import vocab
from quern.functions.units import canonical_name

TEXT = T.StructType([T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("starting_index", T.IntegerType())])
RATIO = T.StructType([T.StructField("num", T.DecimalType(38, 0)), T.StructField("den", T.DecimalType(38, 0))])
_FLAGS = ("approximate", "singular", "range", "multiplier", "prepared_ingredient")
PART = T.StructType(
    [T.StructField("quantity", RATIO), T.StructField("quantity_max", RATIO), T.StructField("quantity_str", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("starting_index", T.IntegerType())]
    + [T.StructField(f, T.BooleanType()) for f in _FLAGS]
)
AMOUNT = T.StructType([T.StructField("kind", T.StringType()), *PART.fields, T.StructField("join", T.StringType()), T.StructField("subtractive", T.BooleanType()), T.StructField("parts", T.ArrayType(PART))])
RECORD = T.StructType([
    T.StructField("name", T.ArrayType(TEXT)), T.StructField("size", TEXT), T.StructField("amount", T.ArrayType(AMOUNT)), T.StructField("preparation", TEXT),
    T.StructField("comment", TEXT), T.StructField("purpose", TEXT),
])

_FRACTION = re.compile(r"^\d*#\d+\$\d+(?:-\d*#\d+\$\d+)?$")
_SPAN = re.compile(r"^[\d#$]+\s*-[\d#$]+$")
_FLOAT = re.compile(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$")
_PLURAL = re.compile(r"\b(" + "|".join(re.escape(x) for x in sorted(vocab.PLURALS, key=len, reverse=True)) + r")\b")
_WORDS = [(re.compile(rf"\b{w}\b", re.IGNORECASE), n) for w, n in vocab.STRING_NUMBERS.items()]
_AND = re.compile(r"(\d+)\sand\s(\d)/(\d+)")
_TO = re.compile(r"(0\.[0-9]|[1-9][\d.]*?|\d*#\d+\$\d+)\s*(-)?\s*(to|or)\s*(-)*\s*((0\.[0-9]+|[1-9][\d.]*?|\d*#\d+\$\d+)(-)?)")
# Marks that cannot begin or end a part; fixed values.
_NO_START = set(") ] } , : ; - . ! ? * & / --".split())
_NO_END = set("[ ( { , : ; - & / * --".split())
_STOP = set(vocab.STOP_WORDS)

# Pairs of amounts that make one: letters of the labels, place of the word between (if any), the word, how they are joined; fixed values.
_COMPOSITES = [
    ("QUQUU", None, None, "", False), ("QUQU", None, None, "", False), ("QUCQU", 2, "plus", " plus ", False), ("QUPQU", 2, "+", " + ", False),
    ("QUPCQU", 3, "plus", " plus ", False), ("QUCQU", 2, "and", " and ", False), ("QUCQU", 2, "minus", " minus ", True), ("QUCQU", 2, "less", " minus ", True),
]


@dataclass
class Options:
    separate_names: bool = True
    discard_isolated_stop_words: bool = True
    string_units: bool = False
    imperial_units: bool = False


@dataclass
class Sentence:
    """The tokens that are left, as parallel lists."""

    tokens: list[str]
    tags: list[str]
    labels: list[str]
    scores: list[float]
    options: Options
    taken: set[int] = field(default_factory=set)

    def letters(self) -> str:
        code = {"QTY": "Q", "UNIT": "U", "COMMENT": "C", "PUNC": "P"}
        return "".join(code.get(x, "_") for x in self.labels)

    def free(self) -> list[int]:
        return [i for i in range(len(self.tokens)) if i not in self.taken]


def mean(values: list[float]) -> float:
    return sum(values) / len(values)


def ratio_of(token: str) -> Fraction:
    """The number of a quantity token; ValueError if it is none."""
    if _FRACTION.match(token) and "-" not in token:
        whole, _, rest = token.partition("#")
        top, _, bottom = rest.partition("$")
        return Fraction(int(whole or 0)) + Fraction(int(top), int(bottom))
    return Fraction(token)


def pluralised(text: str) -> str:
    return _PLURAL.sub(lambda m: vocab.PLURALS[m[0]], text)


def amount(quantity: str, unit: str, confidence: float, at: int, options: Options, **flags: bool) -> dict:
    """One amount; the text is quantity and unit, with the unit in the plural where it belongs."""
    low: Fraction | None = None
    high: Fraction | None = None
    flags = dict.fromkeys(_FLAGS, False) | flags
    try:
        if _SPAN.match(quantity):
            ends = sorted(ratio_of(x.strip()) for x in quantity.split("-"))
            low, high, flags["range"] = ends[0], ends[-1], True
        elif _FLOAT.match(quantity) or _FRACTION.match(quantity):
            low = high = ratio_of(quantity)
        elif quantity.endswith("x"):
            low = high = ratio_of(quantity[:-1])
            flags["multiplier"] = True
    except (ValueError, ZeroDivisionError):
        low = high = None
        flags["range"] = flags["multiplier"] = False
    text = f"{quantity} {unit}".strip()
    known = None if options.string_units else canonical_name(unit, options.imperial_units)
    name = known or unit
    if low != 1 and quantity != "" and not flags["range"]:
        text = pluralised(text)
        if not known:
            name = pluralised(unit)
    text = text.replace("#", " ").replace("$", "/").strip().replace("- ", "-")
    as_ratio = lambda x: x if x is None else {"num": x.numerator, "den": x.denominator}
    return {
        "kind": "amount", "quantity": as_ratio(low), "quantity_max": as_ratio(high), "quantity_str": None if low is not None else quantity, "unit": name, "text": text,
        "confidence": round(confidence, 6), "starting_index": at, **flags, "join": None, "subtractive": None, "parts": None,
    }


def merge_numbers(s: Sentence) -> Sentence:
    """Number words as digits; quantities over several tokens (``1 and 1/2``) as one token."""
    tokens, scores = [*s.tokens], [*s.scores]
    for i, label in enumerate(s.labels):
        if label == "QTY":
            for word, digits in _WORDS:
                tokens[i] = word.sub(digits, tokens[i])
    gone: set[int] = set()
    for run in re.finditer("QQ+", s.letters()):
        text = " ".join(tokens[run.start() : run.end()])
        new = _AND.sub(r"\1#\2$\3", text)
        new = new if new != text else _TO.sub(r"\1-\5", text)
        if new != text:
            tokens[run.start()] = new
            scores[run.start()] = mean(s.scores[run.start() : run.end()])
            gone |= set(range(run.start() + 1, run.end()))
    keep = [i for i in range(len(tokens)) if i not in gone]
    pick = lambda x: [x[i] for i in keep]
    return Sentence(pick(tokens), pick(s.tags), pick(s.labels), pick(scores), s.options)


def _approximate(s: Sentence, free: list[int], k: int) -> list[int]:
    """Tokens that make the quantity at place k of ``free`` approximate."""
    low = [s.tokens[i].lower() for i in free]
    if k >= 1 and low[k - 1] in vocab.APPROXIMATE:
        return [free[k - 1]]
    if k >= 2 and low[k - 1] == "." and low[k - 2] in vocab.APPROXIMATE:
        return [free[k - 1], free[k - 2]]
    return []


def contained(s: Sentence) -> list[dict]:
    """``1 28 ounce can``: the outer amount, and what one of it holds."""
    out = []
    free = s.free()
    places = [k for k, i in enumerate(free) if s.labels[i] in ("QTY", "UNIT")]
    line = "".join("Q" if s.labels[free[k]] == "QTY" else "U" for k in places)
    for pattern in ("QQUQUQUU", "QQUQUU", "QQUU"):
        for m in re.finditer(pattern, line):
            at = places[m.start() : m.end()]
            ids = [free[k] for k in at]
            if s.tokens[ids[-1]] not in vocab.CONTAINERS or s.taken & set(ids):
                continue
            near = _approximate(s, free, at[0])
            s.taken |= {*ids, *near}
            outer = mean([s.scores[ids[0]], s.scores[ids[-1]]])
            out.append(amount(s.tokens[ids[0]], s.tokens[ids[-1]], outer, ids[0], s.options, approximate=bool(near)))
            # An inner amount's confidence is that of its quantity.
            for q, u in zip(ids[1:-1:2], ids[2:-1:2]):
                out.append(amount(s.tokens[q], s.tokens[u], s.scores[q], q, s.options, singular=True, approximate=bool(near)))
    return out


def composites(s: Sentence) -> list[dict]:
    """Amounts of two parts: ``1 lb 2 oz``, ``1 cup plus 1 tbsp``."""
    out = []
    free = s.free()
    all_letters = s.letters()
    line = "".join(all_letters[i] for i in free)
    for pattern, between, word, join, less in _COMPOSITES:
        for m in re.finditer(pattern, line):
            ids = free[m.start() : m.end()]
            if between is None:
                if s.tokens[ids[1]] not in ("lb", "pound", "pt", "pint") or s.tokens[ids[-1]] not in ("oz", "ounce"):
                    continue
            elif s.tokens[ids[between]].lower() != word:
                continue
            if s.taken & set(ids):
                continue
            second = 2 if between is None else between + 1
            a = amount(s.tokens[ids[0]], s.tokens[ids[1]], mean([s.scores[i] for i in ids[:2]]), ids[0], s.options)
            tail = ids[second:]
            b = amount(s.tokens[tail[0]], " ".join(s.tokens[i] for i in tail[1:]), mean([s.scores[i] for i in tail]), tail[0], s.options)
            s.taken |= set(ids)
            parts = [{k: x[k] for k in PART.names} for x in (a, b)]
            text = (join or " ").join(x["text"] for x in parts)
            out.append(dict.fromkeys(AMOUNT.names) | dict.fromkeys(_FLAGS, False) | {
                "kind": "composite", "text": text, "confidence": mean([x["confidence"] for x in parts]), "starting_index": min(x["starting_index"] for x in parts),
                "join": join, "subtractive": less, "parts": parts,
            })
    return out


def simple_amounts(s: Sentence) -> list[dict]:
    """Each quantity with the units up to the next one."""
    free = s.free()
    low = [s.tokens[i].lower() for i in free]
    label = [s.labels[i] for i in free]
    found: list[dict] = []
    for k, i in enumerate(free):
        if label[k] == "QTY":
            if s.tokens[i] == "dozen" and k and label[k - 1] == "QTY" and found:
                found[-1]["q"] += " dozen"
                found[-1]["s"].append(s.scores[i])
            else:
                linked = bool(found) and k > 0 and low[k - 1] in ("(", "/", "[")
                found.append({"q": s.tokens[i], "u": [], "s": [s.scores[i]], "at": i, "linked": linked, "flags": set()})
        elif label[k] == "UNIT":
            if not found:
                found.append({"q": "", "u": [], "s": [], "at": i, "linked": False, "flags": set()})
            found[-1]["u"].append(s.tokens[i])
            found[-1]["s"].append(s.scores[i])
        used: list[int] = []
        if label[k] == "QTY":
            used = _approximate(s, free, k)
            if used:
                found[-1]["flags"].add("approximate")
            if k >= 2 and low[k - 1] in vocab.APPROXIMATE and low[k - 2] in vocab.SINGULAR:
                found[-1]["flags"] |= {"approximate", "singular"}
                used = [*used, free[k - 2]]
            # ``to yield`` and the like right before, or before one exactly written qualifier.
            back = 1 if k > 2 and s.tokens[free[k - 1]] in vocab.APPROXIMATE and low[k - 3 : k - 1] in vocab.PREPARED else 0
            if k >= 2 and low[k - 2 - back : k - back] in vocab.PREPARED:
                found[-1]["flags"].add("prepared_ingredient")
                used = [*used, free[k - 1 - back], free[k - 2 - back]]
        elif label[k] == "UNIT":
            step = 2 if k + 2 < len(free) and low[k + 1] in (")", "]") else 1
            if k + step < len(free) and low[k + step] in vocab.SINGULAR:
                found[-1]["flags"].add("singular")
                used = [free[k + step]]
        s.taken |= set(used)
    # Flags hold for all amounts that are linked by brackets or slashes.
    groups: list[list[dict]] = []
    for x in found:
        if x["linked"]:
            groups[-1].append(x)
        else:
            groups.append([x])
    out = []
    for group in groups:
        flags = set().union(*(x["flags"] for x in group))
        out += [amount(x["q"], " ".join(x["u"]), mean(x["s"]), x["at"], s.options, **dict.fromkeys(flags, True)) for x in group]
    return out


def _valid(s: Sentence, run: list[int]) -> list[int]:
    """Without marks at the wrong end and without brackets that have no partner."""
    while len(run) > 1 and s.tokens[run[0]] in _NO_START:
        run = run[1:]
    while len(run) > 1 and s.tokens[run[-1]] in _NO_END:
        run = run[:-1]
    lonely: set[int] = set()
    for pair in ("()", "[]"):
        open_: list[int] = []
        for i in run:
            if s.tokens[i] == pair[0]:
                open_.append(i)
            elif s.tokens[i] == pair[1] and open_:
                open_.pop()
            elif s.tokens[i] == pair[1]:
                lonely.add(i)
        lonely |= set(open_)
    return [i for i in run if i not in lonely]


def _runs(ids: list[int]) -> list[list[int]]:
    """Groups of neighbours, in the order given."""
    out: list[list[int]] = []
    for i in ids:
        if out and i == out[-1][-1] + 1:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def tidy(text: str) -> str:
    text = text.replace("( ", "(").replace(" )", ")").replace(" / ", "/")
    return re.sub(r" ([,:;.!?*])", r"\1", text).strip()


def rendered(s: Sentence, ids: list[int], glue: str) -> dict | None:
    """One text from token places; takes the tokens it uses."""
    parts: list[tuple[str, float]] = []
    first = ids[-1]
    for run in _runs(ids):
        run = _valid(s, run)
        if all(s.labels[i] == "PUNC" for i in run):
            continue
        words = [s.tokens[i].replace("#", " ").replace("$", "/").strip().replace("- ", "-") if _FRACTION.match(s.tokens[i]) else s.tokens[i] for i in run]
        text = " ".join(words)
        if s.options.discard_isolated_stop_words and text.lower() in _STOP:
            continue
        s.taken |= set(run)
        parts.append((text, mean([s.scores[i] for i in run])))
        first = min(first, run[0])
    parts = [p for p, nxt in zip(parts, [*parts[1:], ("", 0.0)]) if p[0] != nxt[0]]
    if not parts:
        return None
    return {"text": tidy(glue.join(t for t, _ in parts)), "confidence": round(mean([c for _, c in parts]), 6), "starting_index": first}


def one_text(s: Sentence, label: str) -> dict | None:
    ids = [i for i in s.free() if s.labels[i] in (label, "PUNC")]
    if all(s.labels[i] == "PUNC" for i in ids):
        return None
    return rendered(s, ids, " " if label == "NAME" else ", ")


def name_places(labels: list[str]) -> list[list[int]]:
    """Places of each name among name labels.

    Segments are read from the right: a variant stands before the name that
    follows it, a modifier before every name to its right.
    """
    segments: list[tuple[str, list[int]]] = []
    last = None
    for i, label in enumerate(labels):
        if label == "NAME_SEP":
            segments.append(("|", []))
        elif label.startswith("B_") or label in ("NAME_MOD", "NAME_VAR") and last != label or not segments or segments[-1][0] == "|":
            segments.append(("", [i]))
        else:
            segments[-1][1].append(i)
        last = label
    names: list[list[int]] = []
    base: list[int] | None = None
    used = True
    for _, places in reversed([x for x in segments if x[1]]):
        kind = next((labels[i].rsplit("_", 1)[-1] for i in places if labels[i] != "PUNC"), "")
        if kind in ("TOK", "MOD") and base is not None and not used:
            names.append(base)
            used = True
        if kind == "TOK":
            base, used = places, False
        elif kind == "VAR":
            names.append(places + (base or []))
            used = True
        elif kind == "MOD":
            names = [places + n for n in names]
    if base is not None and not used:
        names.append(base)
    return names[::-1]


def names_of(s: Sentence) -> list[dict]:
    ids = [i for i in s.free() if "NAME" in s.labels[i] or s.labels[i] == "PUNC"]
    if all(s.labels[i] == "PUNC" for i in ids):
        return []
    groups, waiting = [], []
    for places in name_places([s.labels[i] for i in ids]):
        tokens = waiting + [ids[p] for p in places]
        tag = next((s.tags[i] for i in reversed(tokens) if s.labels[i] != "PUNC"), "")
        # A name that ends in a determiner, preposition or adjective goes on in the next.
        waiting = tokens if tag in ("DT", "IN", "JJ") else []
        if not waiting:
            groups.append(tokens)
    if waiting:
        groups.append(waiting)
    out: dict[str, dict] = {}
    for tokens in groups:
        made = rendered(s, tokens, " ")
        if made and made["text"] in out:
            old = out[made["text"]]
            old["confidence"] = round((old["confidence"] + made["confidence"]) / 2, 6)
            old["starting_index"] = min(old["starting_index"], made["starting_index"])
        elif made:
            out[made["text"]] = made
    return [*out.values()]


def assemble(tokens: list[str], tags: list[str], labels: list[str], scores: list[float], options: Options) -> dict:
    """The record of one sentence."""
    s = merge_numbers(Sentence([*tokens], [*tags], [*labels], [*map(float, scores)], options))
    amounts = sorted([*contained(s), *composites(s), *simple_amounts(s)], key=lambda a: a["starting_index"])
    if options.separate_names:
        names = names_of(s)
    else:
        s.labels = ["NAME" if "NAME" in x else x for x in s.labels]
        names = [x for x in [one_text(s, "NAME")] if x]
    out = {"name": names, "size": one_text(s, "SIZE"), "amount": amounts}
    out |= {"preparation": one_text(s, "PREP"), "comment": one_text(s, "COMMENT"), "purpose": one_text(s, "PURPOSE")}
    if names and out["preparation"]:
        prep, starts = out["preparation"]["starting_index"], [n["starting_index"] for n in names]
        for a in amounts:
            if a["starting_index"] < prep < min(starts) or max(starts) < prep < a["starting_index"]:
                for x in a["parts"] or [a]:
                    x["prepared_ingredient"] = True
    return out


def record(tokens: Column, tags: Column, labels: Column, scores: Column, **options: bool) -> Column:
    """``RECORD`` of array Columns of equal length; null or unequal arrays give null."""
    chosen = Options(**options)

    @F.pandas_udf(RECORD)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t, p, l, s in zip(*batch):
                fits = all(x is not None for x in (t, p, l, s)) and len({len(t), len(p), len(l), len(s)}) == 1
                rows.append(assemble(t, p, l, s, chosen) if fits else dict.fromkeys(RECORD.names))
            yield pd.DataFrame(rows, columns=RECORD.names)

    return run(tokens, tags, labels, scores)

"""Text that breaks off: a hashed logistic regression on how texts close.

Intact values are cut at hash-chosen places to make positives; the same
values uncut are the negatives.  Features are hashed strings about the
closing characters, the last line and paragraph, open structures (quotes,
brackets, fences, images, containers, table rows) and the distance of the
length to the source's limit.  Every record is then scored on its whole
text.  Only the fit uses a bounded sample (``SAMPLE``); lengths and limits
are counted over all records.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import blank
from quern.runtime import broadcast_if_small, materialise

#: Bound on the values that the fit cuts and learns from.
SAMPLE = 12_000
CUTS = 3
BITS = 18
#: Least number, and share, of the sampled values that a feature must occur in.
RARE, RARE_SHARE = 4, 0.003
#: A source's longest length is a limit if this share of its texts, and this number, have it.
LIMIT_SHARE, LIMIT_LEAST = 0.01, 3

_RUNS = re.compile(r"[^\W\d_]+|\d+")
_WORDS = re.compile(r"[^\W_]+")
_ENDS = ".!?"


def _shape(text: str) -> str:
    return _RUNS.sub(lambda m: "9" if m[0][0].isdigit() else "a", text)


def _exact(text: str) -> str:
    """Shape with the lengths of digit runs."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d", "9", text))


def _numbers(line: str) -> list[str]:
    return re.findall(r"\S+", line)


def _open_marks(part: str) -> list[str]:
    """Brackets and quotes that the part leaves open."""
    depth: list[str] = []
    i, n, quote = 0, len(part), ""
    while i < n:
        c = part[i]
        if quote:
            if c == "\\":
                i += 1
            elif part.startswith(quote, i):
                i += len(quote) - 1
                quote = ""
            elif c == "\n" and len(quote) == 1:
                quote = ""
        elif part.startswith('"""', i):
            quote, i = '"""', i + 2
        elif c == '"' or c == "'" and (i == 0 or not part[i - 1].isalnum()):
            quote = c
        elif c in "([{":
            depth.append(c)
        elif c in ")]}" and depth:
            depth.pop()
        i += 1
    return [*(["quote" + quote] if quote else []), *["in" + x for x in depth[-2:]]]


def _container(text: str) -> str:
    """Whether a text that is one JSON object is closed; '' for other texts."""
    head = text[:1]
    if head not in "{[" or not re.match(r'[{\[]\s*["{\[]', text):
        return ""
    try:
        json.loads(text)
    except ValueError:
        return "broken" if text.rstrip()[-1:] in "]}" else "open"
    return "closed"


def features(text: str, at_limit: bool = False) -> list[str]:
    """Feature strings of one text."""
    box = _container(text)
    if box:
        # What a whole object ends in tells nothing more.
        return ["bias", f"box {box}", f"limit {at_limit}"]
    body = text.rstrip()
    tail = body[-60:]
    line_at = body.rfind("\n") + 1
    line = body[line_at:]
    part_at = body.rfind("\n\n") + 2 if "\n\n" in body else 0
    part = body[part_at:]
    lines = part.split("\n")
    last = _WORDS.findall(line[-80:])
    word = last[-1] if last else ""
    out = ["bias", f"limit {at_limit}", f"space {text[-1:] if text[-1:].isspace() else ''!r}"]
    fences = len(re.findall(r"(?m)^```", body))
    fence = "odd" if fences % 2 else "even" if fences else "none"
    out.append(f"fence {fence}")
    marks = list(re.finditer(r"(?m)^(# %%.*|In \[\d+\]:|Out\[\d+\]:)$", body))
    kind = ""
    if marks:
        kind = _shape(marks[-1][0])
        if kind.startswith("In") and "\n\n" in body[marks[-1].end():]:
            kind += " then"
    out.append(f"cell {kind}")
    prose = bool(re.match(r"[^\W\d_]+,? [^\W\d_]+ [^\W\d_]+ ", line)) and len(last) >= 1 and not re.search(r"[=_\[\](){}<>]", line.replace("(", "", 1).replace(")", "", 1))
    head = "#" if line.startswith("#") else "-" if line.startswith(("- ", "* ")) else "p" if prose else "s" if line.startswith(" ") else "o"
    closed = line[-1:] in _ENDS
    code_line = not prose and head in "so"
    image = "base64," in line
    out += [f"head {head} {closed}", f"head {head} {line[-1:]!r}" if not line[-1:].isalnum() else f"head {head} alnum"]
    if image:
        return [*out[:4], f"image {line[-1:] == ')'}", f"image {fence} {line[-1:] == ')'}"]
    open_ = _open_marks(part if code_line else line) if not prose else []
    for x in open_:
        out.append(f"open {x}")
    out.append(f"opens {bool(open_)} {head}")
    for n in (3, 6, 10, 16):
        out.append(f"tail{n} {head} {_shape(tail)[-n:]}")
    out.append(f"exact {_exact(line)[-12:]}")
    out.append(f"line {_shape(line)[:24]}" if len(line) < 80 else "line long")
    out.append(f"lineend {_shape(line)[:12]} {_shape(line)[-4:]}")
    out.append(f"words {head} {min(len(_WORDS.findall(line)), 9)} {closed}")
    if not prose or not closed:
        out.append(f"word {word[:12].lower()} {line[-1:].isalnum()}")
    if len(line) < 48:
        out.append(f"whole {re.sub(r'[0-9]+', '9', line)}")
        out.append(f"wrap {line[:1] if not line[:1].isalnum() else 'a'}{line[-1:] if not line[-1:].isalnum() else 'a'} {bool(open_)}")
        out.append(f"first {line.split(' ')[0][:16]}")
    # Rows of numbers: as many columns, and as many digits, as the row before.
    if len(lines) > 1 and re.search(r"\d$", line):
        now, before = _numbers(line), _numbers(lines[-2])
        if len(before) > 1 and len(now) >= 1:
            digits = lambda x: len(x.rpartition(".")[2]) if "." in x else -1
            out.append(f"row {len(now) - len(before)} {digits(now[-1]) - digits(before[-1])}")
            out.append(f"rowtail {min(len(line) - len(lines[-2]), 1) if len(line) >= len(lines[-2]) - 6 else -6}")
        prior = _exact(lines[-2])
        out.append(f"sameshape {prior == _exact(line)} {_shape(lines[-2]) == _shape(line)}")
    elif code_line and len(lines) > 1:
        out.append(f"after {_shape(lines[-2])[:14]} | {_shape(line)[:14]}")
        out.append(f"after {lines[-2].strip()[:6]} | {line.strip()[:6]} {bool(open_)}")
    if code_line:
        out.append(f"code {line.strip()[:4]} {_shape(line)[-3:]} {bool(open_)}")
    return out


def hashed(names: list[str]) -> list[int]:
    return sorted({zlib.crc32(x.encode()) & (1 << BITS) - 1 for x in names})


def _cut_at(text: str, key: int) -> int:
    """A place that leaves the text unfinished, 0 if there is none near the key."""
    n = len(text)
    if n < 40:
        return 0
    at = 20 + key % (n - 20)
    for _ in range(8):
        before, after = text[at - 1], text[at : at + 1]
        if not (before.isspace() or before in _ENDS + ")`" or after in "\n"):
            return at
        at = at + 1 if at + 2 < n else 20
    return 0


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _examples(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Features of the value and of its cuts; the limits are those of all sources, one by turns."""
    for texts, keys, limits in batches:
        out = []
        for text, key, limit in zip(texts, keys, limits):
            own = [hashed(features(text))]
            for c in range(CUTS):
                at = _cut_at(text, (key >> 8 * c) & 0xFFFFFF)
                if c == 0 and limit and len(text) > limit:
                    own.append(hashed(features(text[: int(limit)], True)))
                elif at:
                    own.append(hashed(features(text[:at])))
            out.append(own)
        yield pd.Series(out)


def fit(rows: list[tuple[list[int], int]], epochs: int = 20, rate: float = 0.2, decay: float = 1e-3, batch: int = 256) -> np.ndarray:
    """Weights of a logistic regression on hashed 0/1 features (Adagrad, fixed order)."""
    weights, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    if not rows:
        return weights
    rng = np.random.default_rng(7)
    sizes = np.array([len(x) for x, _ in rows])
    flat = np.concatenate([np.asarray(x, np.int64) for x, _ in rows])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    y = np.array([t for _, t in rows], float)
    # Both classes weigh the same.
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for b in range(0, len(order), batch):
            ids = order[b : b + batch]
            idx = np.concatenate([flat[starts[i] : starts[i + 1]] for i in ids])
            who = np.repeat(np.arange(len(ids)), sizes[ids])
            z = np.bincount(who, weights[idx], len(ids))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            g = np.bincount(idx, ((p - y[ids]) * balance[ids])[who], 1 << BITS)
            used = np.unique(idx)
            gu = g[used] + decay * len(ids) * weights[used]
            seen[used] += gu * gu
            weights[used] -= rate * gu / np.sqrt(seen[used])
    return weights


def robust_fit(examples: list[list[list[int]]]) -> np.ndarray:
    """Fits on values that may themselves be cut already.

    ``examples``: per value the features of the value, then those of its
    cuts.  Features of too few values are left out, as they only
    let the fit remember single values.  Each half is judged by a fit on the
    other half, and values that look cut there are no negatives in the end.
    """
    counts = np.zeros(1 << BITS, np.int64)
    for x in examples:
        counts[np.unique(np.concatenate([np.asarray(f, np.int64) for f in x]))] += 1
    kept = counts >= max(RARE, RARE_SHARE * len(examples))
    examples = [[[i for i in f if kept[i]] or [0] for f in x] for x in examples]

    def rows(part: list[list[list[int]]], skip: set[int] = frozenset()) -> list[tuple[list[int], int]]:
        return [(f, int(i > 0)) for n, x in enumerate(part) for i, f in enumerate(x) if i or n not in skip]

    skip: set[int] = set()
    for side in (0, 1):
        weights = fit(rows(examples[1 - side :: 2]))
        skip |= {2 * n + side for n, x in enumerate(examples[side::2]) if weights[x[0]].sum() > 0}
    return fit(rows(examples, skip))


def _scored(shared):  # noqa: ANN001, ANN202
    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        weights = np.frombuffer(shared.value)
        for texts, limits in batches:
            z = np.array([weights[hashed(features(t, bool(x)))].sum() for t, x in zip(texts, limits)])
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score


def prepared(docs: DataFrame, doc_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``at_limit``, and ``source, limit`` of the sources that have one."""
    rows = docs.select(F.col(doc_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    rows = rows.where(~blank(F.col("text"))).withColumn("n", F.length("text"))
    # Counted from the lengths alone; one row per source comes out.
    lengths = rows.groupBy("source", "n").agg(F.count(F.lit(1)).alias("k"))
    limits = lengths.groupBy("source").agg(F.max("n").alias("limit"), F.max_by("k", "n").alias("at"), F.sum("k").alias("all"))
    limits = limits.where((F.col("at") >= LIMIT_LEAST) & (F.col("at") >= LIMIT_SHARE * F.col("all"))).select("source", "limit")
    limits = materialise(limits)
    rows = rows.join(broadcast_if_small(limits), "source", "left").withColumn("at_limit", F.coalesce(F.col("n") == F.col("limit"), F.lit(False)))
    return rows, limits


def learn(rows: DataFrame, limits: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most about ``sample`` values that are not at a limit."""
    total = rows.where("not at_limit").count()
    every = max(1, -(-total // sample))
    lot = rows.where("not at_limit").where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(every)) == 0)
    # Some limit for each value, so that closing at a limit is learned whatever the source.
    known = sorted(r["limit"] for r in limits.select("limit").distinct().orderBy("limit").limit(100).collect())
    turn = F.element_at(F.array(*[F.lit(x) for x in known]), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(len(known))).cast("int") + 1) if known else F.lit(0)
    made = lot.select(_examples("text", F.xxhash64("doc_id", F.lit(9)), turn.cast("int")).alias("x")).toPandas()
    return robust_fit([[list(f) for f in x] for x in made["x"]])


def scored(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", source_col: str = "source", sample: int = SAMPLE) -> DataFrame:
    """``doc_id, source, at_limit, score``: how surely each text breaks off.

    Null and blank texts have no row.  Without any value to learn from every
    score is 0.5.  A null source is a source like any other without a limit.
    """
    rows, limits = prepared(docs, doc_col, text_col, source_col)
    shared = docs.sparkSession.sparkContext.broadcast(learn(rows, limits, sample).tobytes())
    return rows.select("doc_id", "source", "at_limit", _scored(shared)("text", F.col("at_limit")).alias("score"))


def found(docs: DataFrame, threshold: float = 0.6, **columns: str) -> DataFrame:
    """``doc_id`` of the texts that break off."""
    return scored(docs, **columns).where(F.col("score") > threshold).select("doc_id").distinct()


def report(docs: DataFrame, threshold: float = 0.6, **columns: str) -> DataFrame:
    """Per source: ``source, n_docs, n_cut, share, n_at_limit``."""
    cut = F.col("score") > threshold
    out = scored(docs, **columns).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(cut).alias("n_cut"), F.count_if("at_limit").alias("n_at_limit"))
    return out.withColumn("share", F.col("n_cut") / F.col("n_docs"))

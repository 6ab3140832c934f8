"""Held-out passages inside a corpus, by a generalised suffix automaton.

The normalised words of all items go into one suffix automaton; the words of
a document are streamed through it and the longest match ending at each word
is tracked.  Items are a stated query set: they are taken in blocks of
bounded size, each block's automaton is built on the driver, broadcast and
run against all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import blank, rows_of, word_list
from quern.runtime import materialise

#: Words of the items in one automaton; the bound on what is broadcast (about 0.3 kB a word).
BLOCK_WORDS = 200_000
#: A longer item is cut into overlapping pieces of so many words.
PIECE_WORDS = 50_000

_WORD = re.compile(r"[^\W_]+")


class Automaton:
    """Generalised suffix automaton over the word lists of items.

    ``least`` is the shortest match of interest.  ``items[s]`` names the items
    that hold the ``least``-word suffix which state ``s`` stands for.
    """

    def __init__(self, items: list[tuple[int, int, list[str]]], least: int) -> None:
        """``items``: (id, words of the whole item, words of the item or of a piece of it)."""
        self.least = least
        self.ids: dict[str, int] = {}
        self.pairs: set[tuple[str, str]] = set()
        self.sizes = {i: size for i, size, _ in items}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int]] = []
        for item, _, words in items:
            last = 0
            for n, w in enumerate(words):
                last = self._add(last, self.ids.setdefault(w, len(self.ids)))
                if n + 1 >= least:
                    ends.append((last, item))
            self.pairs.update(zip(words, words[1:]))
        # The state whose class holds the suffix of exactly ``least`` words.
        self.base = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            self.base[s] = self.base[up] if self.length[up] >= least else s if self.length[s] >= least else 0
        self.items: dict[int, set[int]] = {}
        for s, item in ends:
            self.items.setdefault(self.base[s], set()).add(item)

    def _add(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def matches(self, words: list[str]) -> list[tuple[int, int, int]]:
        """``(item, first word, words)`` of all maximal matches of at least ``least`` words."""
        # A match holds least - 1 word pairs in a row, so one starts at a multiple of least - 1.
        step, pairs = max(1, self.least - 1), self.pairs
        hits = [j for j in range(0, len(words) - 1, step) if (words[j], words[j + 1]) in pairs] if self.least > 1 else [*range(len(words))]
        if not hits:
            return []
        out: dict[tuple[int, int], int] = {}
        end = 0
        at = 0
        while at < len(hits):
            lo, hi = max(end, hits[at] - step), hits[at] + step + 2
            at += 1
            while at < len(hits) and hits[at] - step <= hi:
                hi = hits[at] + step + 2
                at += 1
            end = min(hi, len(words))
            self._stream(words, lo, end, out)
        return [(item, first, n) for (item, first), n in sorted(out.items())]

    def _stream(self, words: list[str], lo: int, hi: int, out: dict[tuple[int, int], int]) -> None:
        nxt, link, length, base, least = self.next, self.link, self.length, self.base, self.least
        get = self.ids.get
        s = n = 0
        open_: dict[int, int] = {}
        for i in range(lo, hi):
            c = get(words[i])
            if c is None:
                s = n = 0
            else:
                while s and c not in nxt[s]:
                    s = link[s]
                    n = length[s]
                if c in nxt[s]:
                    s = nxt[s][c]
                    n += 1
            if n >= least:
                now = self.items.get(base[s], ())
                for item in [x for x in open_ if x not in now]:
                    del open_[item]
                for item in now:
                    # A run of one item goes on while its least-word suffix matches.
                    first = open_.setdefault(item, i - least + 1)
                    out[item, first] = i - first + 1
            elif open_:
                open_ = {}


def _scan(shared, keep):  # noqa: ANN001, ANN202
    hit = T.StructType([T.StructField(n, t) for n, t in (("item_id", T.LongType()), ("n_words", T.IntegerType()), ("start", T.IntegerType()), ("end", T.IntegerType()))])

    @F.pandas_udf(T.ArrayType(hit))
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = shared.value
        for texts in batches:
            out = []
            for text in texts:
                low = text.lower()
                found = [m for m in automaton.matches(_WORD.findall(low)) if keep(m[2], automaton.sizes[m[0]])]
                if not found:
                    out.append([])
                    continue
                if len(low) != len(text):
                    # Some capitals change length in lower case; places must be those in the text.
                    at = [m.span() for m in _WORD.finditer(text)]
                    if len(at) != len(_WORD.findall(low)):
                        at = [m.span() for m in _WORD.finditer(low)]
                else:
                    at = [m.span() for m in _WORD.finditer(low)]
                out.append([{"item_id": i, "n_words": n, "start": at[a][0], "end": at[a + n - 1][1]} for i, a, n in found])
            yield pd.Series(out)

    return scan


def hits(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_words: int = 20, max_cover: float | None = None, least: int = 8) -> DataFrame:
    """``doc_id, item_id, n_words, start, end``: maximal runs of an item's words in a document.

    A run counts from ``max_words`` consecutive words on, or, if ``max_cover``
    is given, from that share of the item's words on (at least ``least``
    words).  ``start`` and ``end`` are character places in the text.  Null
    and blank texts and items have no hits; equal items hit alike; whole
    texts of any length are streamed.
    """
    spark = docs.sparkSession
    shortest = max_words if max_cover is None else min(least, max_words)
    known = materialise(rows_of(items, item_col, item_text_col).where(~blank(F.col("text"))).select("id", word_list(F.col("text")).alias("words")))
    cut = F.expr(f"transform(sequence(1, greatest(1, size(words) - {shortest} + 1), {PIECE_WORDS}), i -> slice(words, i, {PIECE_WORDS} + {shortest} - 1))")
    known = known.select("id", F.size("words").alias("size"), F.posexplode(cut).alias("piece", "words"))
    total = known.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS) or 1
    texts = rows_of(docs, doc_col, text_col).where(~blank(F.col("text")))
    parts = []
    for b in range(blocks):
        block = known.where(F.pmod(F.xxhash64("id", "piece"), F.lit(blocks)) == b)
        listed = [(r["id"], r["size"], list(r["words"])) for r in block.collect()]
        shared = spark.sparkContext.broadcast(Automaton(listed, shortest))
        if max_cover is None:
            keep = lambda n, size: n >= max_words
        else:
            keep = lambda n, size: n >= max_words or n >= max_cover * size
        hit = texts.select(F.col("id").alias("doc_id"), F.explode(_scan(shared, keep)("text")).alias("_h"))
        parts.append(hit.select("doc_id", "_h.*"))
    return reduce(DataFrame.unionByName, parts)


def found(docs: DataFrame, items: DataFrame, max_words: int = 20, **columns: str) -> DataFrame:
    """``doc_id, item_id``: documents with at least ``max_words`` consecutive words of an item."""
    return hits(docs, items, max_words=max_words, **columns).select("doc_id", "item_id").distinct()


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """Per leaked item: ``item_id, n_docs, n_hits, longest`` (words)."""
    return hits(docs, items, **options).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_hits"), F.max("n_words").alias("longest"))


def cleaned(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:  # noqa: ANN003
    """``doc_id, text, n_removed``: every document, without its leaked spans.

    Overlapping spans are removed once.  Null stays null.
    """
    spans = hits(docs, items, doc_col, text_col, **options)
    spans = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    rows = rows_of(docs, doc_col, text_col).withColumnRenamed("id", "doc_id")
    both = rows.join(spans, "doc_id", "left")
    whole = both.where("spans is null").select("doc_id", "text", F.lit(0).alias("n_removed"))
    cut = both.where("spans is not null").select("doc_id", _cut("text", "spans").alias("text"), F.size("spans").alias("n_removed"))
    return whole.unionByName(cut)


@F.pandas_udf(T.StringType())
def _cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, spans in batches:
        out = []
        for text, cuts in zip(texts, spans):
            kept, at = [], 0
            for a, b in sorted((x["start"], x["end"]) for x in cuts):
                if a > at:
                    kept.append(text[at:a])
                at = max(at, b)
            out.append("".join([*kept, text[at:]]))
        yield pd.Series(out)

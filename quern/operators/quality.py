"""Checks and searches of labelled sentences (``id, source, sentence, tokens, labels``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.tokens import sublist_index


def token_mismatches(df: DataFrame, tokeniser: Column) -> DataFrame:
    """``id, stored, computed`` where the stored tokens are not those that ``tokeniser`` gives."""
    rows = df.select("id", F.col("tokens").alias("stored"), tokeniser.alias("computed"))
    return rows.where(~F.col("stored").eqNullSafe(F.col("computed")))


def length_mismatches(df: DataFrame) -> DataFrame:
    """``id, n_tokens, n_labels`` where they differ; a null list counts as empty."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return df.select("id", size("tokens").alias("n_tokens"), size("labels").alias("n_labels")).where("n_tokens <> n_labels")


def conflicting_sentences(df: DataFrame) -> DataFrame:
    """``sentence, n_rows, n_labellings`` of sentences with several label lists."""
    # Counted per labelling first, so that a sentence with very many rows is summed map-side.
    per = df.where("sentence is not null").groupBy("sentence", "labels").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("sentence").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_labellings")).where("n_labellings > 1")


def broken_bio(df: DataFrame) -> DataFrame:
    """``id, idx, label``: an ``I_`` label that follows neither its ``B_`` nor its ``I_``, other labels between passed over."""
    begun = F.filter(F.transform("labels", lambda x, i: F.struct(x.alias("label"), i.alias("idx"))), lambda s: s["label"].startswith("B_") | s["label"].startswith("I_"))
    bad = F.filter(F.transform("_b", lambda s, k: F.struct(s["idx"].alias("idx"), s["label"].alias("label"), F.get(F.col("_b"), k - 1)["label"].alias("prev"))), lambda s: s["label"].startswith("I_") & (s["prev"].isNull() | (F.substring(s["prev"], 3, 99) != F.substring(s["label"], 3, 99))))
    return df.withColumn("_b", begun).select("id", F.explode(bad).alias("_x")).select("id", "_x.idx", "_x.label")


def without_other(df: DataFrame, merge_names: bool = False) -> DataFrame:
    """Training rows: none with the label OTHER; name labels as NAME if ``merge_names``; unequal lists left out."""
    out = df.where(~F.array_contains("labels", "OTHER") & (F.size("tokens") == F.size("labels")))
    if merge_names:
        out = out.withColumn("labels", F.transform("labels", lambda x: F.when(x.contains("NAME"), "NAME").otherwise(x)))
    return out


def search(df: DataFrame, tokens: list[str], labels: list[str] | None = None, sources: list[str] | None = None, whole_words: bool = True, any_case: bool = True) -> DataFrame:
    """Rows that hold ``tokens`` in a row; the labels at their first place must all be in ``labels``."""
    if sources is not None:
        df = df.where(F.col("source").isin(sources))
    at = sublist_index(F.col("tokens"), tokens, whole_words, any_case)
    out = df.withColumn("place", at).where("place >= 0")
    if labels is not None:
        out = out.where(F.size(F.array_except(F.slice("labels", F.col("place") + 1, len(tokens)), F.array(*[F.lit(x) for x in labels]))) == 0)
    return out


def by_ids(df: DataFrame, spec: str, id_col: str = "id") -> DataFrame:
    """Rows named by ``1,5..9,12``; a part that is neither is an error.  Ranges stay ranges, so nothing is expanded."""
    cond = F.lit(False)
    for part in filter(None, (x.strip() for x in spec.split(","))):
        lo, _, hi = part.partition("..")
        if not lo.isdigit() or (hi and not hi.isdigit()) or (".." in part and not hi):
            raise ValueError(f"not an id or range: {part}")
        cond = cond | F.col(id_col).between(int(lo), int(hi or lo))
    return df.where(cond)


def by_id_table(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is in a table of any size."""
    return df.join(ids.select(id_col).distinct(), id_col, "left_semi")


def page(df: DataFrame, offset: int, size: int = 250, id_col: str = "id") -> DataFrame:
    """One page in id order."""
    return df.orderBy(id_col).offset(offset).limit(size)


def dispatch(df: DataFrame, text: str, offset: int = 0, size: int = 250, id_col: str = "id", **options) -> DataFrame:  # noqa: ANN003
    """One page of what a search text asks for, with ``total``, the number of all rows found.

    ``==1,5..9`` asks for ids and ranges, ``**`` and ``~~`` for all rows,
    anything else for the words in a row (``search``, which takes the options).
    """
    if text.startswith("=="):
        found = by_ids(df, text[2:], id_col)
    elif text.startswith(("**", "~~")):
        found = df
    else:
        found = search(df, text.split(), **options).select(*df.columns)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return page(found, offset, size, id_col).crossJoin(F.broadcast(total))


def sources(df: DataFrame) -> DataFrame:
    return df.select("source").where("source is not null").distinct()


def upsert(df: DataFrame, changes: DataFrame, deleted: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """The table after an upload: changed rows replaced or added, deleted ids gone."""
    kept = df.join(changes.select(id_col), id_col, "left_anti").unionByName(changes)
    return kept if deleted is None else kept.join(deleted.select(id_col), id_col, "left_anti")

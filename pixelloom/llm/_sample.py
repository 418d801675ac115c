"""Bounded samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """Fold of a document: crc32 of its id as text, modulo folds."""
    return F.crc32(doc_id.cast("string")) % folds


def thinned(rows: DataFrame, most: int, *by: str, seed: int = 0) -> DataFrame:
    """About `most` of the rows at the most, chosen by a hash of the columns `by` (all rows where there are no more).

    Rows that agree in `by` stay or go together; where those are so many that over twice `most` would stay, any
    2 * most of them stay. Rows with nulls in `by` are chosen like others; an empty table gives no rows.
    """
    n = rows.count()
    if n <= most:
        return rows
    kept = rows.where(F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return kept.limit(2 * most) if kept.count() > 2 * most else kept


def chosen_texts(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, label) of about `most` labelled rows at the most; an id that stands on several rows of docs gives a row for each.

    Of the labels (doc_id, label) so many are broadcast at most.
    """
    keys = thinned(labels, most, "doc_id", "label")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(keys), "doc_id").select("doc_id", "text", "label")
    return thinned(rows, most, "doc_id", "text", "label", seed=1)

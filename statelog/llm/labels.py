"""Folds, and bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text (0)."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def labelled(labels: DataFrame, label: str, allowed: Column) -> DataFrame:
    """(doc_id, label) of the ids that may be learned from.

    Ids or labels that are null take no part; of several labels of one id the
    largest counts.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & allowed)
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_sample(labels: DataFrame, label: str, allowed: Column, most: int) -> DataFrame:
    """At most ``most`` rows of ``labelled``, those of the smallest hash.

    The bound makes the result fit for broadcasting.
    """
    return labelled(labels, label, allowed).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most)


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(text, label) of the documents in a sample, by a broadcast of its bounded ids.

    Of several rows of one id the greatest text counts, so that the bound of the
    sample holds for rows too, however often an id is repeated.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label")).select("text", "label")

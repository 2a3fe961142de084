"""A training corpus from ``documents``: rejected, repeated and leaked texts out, secrets blanked, sources mixed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelog.llm.decontam import uncontaminated
from statelog.llm.minhash import near_duplicates
from statelog.llm.mixing import mixed_blocks
from statelog.llm.quality import keep_good
from statelog.llm.secrets import redact_secrets
from statelog.llm.staging import delete, numbered, removed_after, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose texts the nearest labelled texts vote for, those without id included."""
    return keep_good(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that is alike on shingles of five words, the first of them.

    Rows are told apart by written numbers of their own, so that rows with equal
    or null ids count like others. Texts without words are alike with nothing.
    """
    rows, key = numbered(docs)
    found = near_duplicates(rows, id_col=key, words=5, threshold=(80, 100))
    kept = found.filter("kept").select(F.col("doc_id").alias("at"))
    return rows.join(kept, rows[key] == kept["at"], "left_semi").drop(key)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no test item, also among rows with equal or null ids."""
    return uncontaminated(docs, _table(spark, sf_dir, "benchmark"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each secret in a text replaced by its kind; null texts stay null."""
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: blocks of words of whole documents (shard, slot, source, block, doc_ids, text)."""
    return mixed_blocks(docs, weights=(3, 1, 2), share=1.5, most=2.0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("blank_secrets", blank_secrets),
    ("mix", mix),
]

#: Votes of neighbours, alignments and key encodings are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next.

    A stage's table is removed once the next one is written, what a stage
    staged for itself as soon as its own is.
    """
    docs = _table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES:
        with removed_after(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            delete(spark, last)
        last = f"{folder}/{name}"
    return docs

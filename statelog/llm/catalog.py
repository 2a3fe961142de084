"""The queries of this subpackage over the test tables, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .decontam import contaminated
from .html import main_texts
from .langid import language
from .minhash import near_duplicates
from .mixing import mixed_words
from .quality import quality
from .secrets import BASE_KINDS, find_secrets
from .staging import Stage
from .tokens import length_histogram, suffix_sums
from .toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by shingles of four words; no words, no links."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text; a quarter of the ids is never learned from."""
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=4, held=2, cut=0.3)
    return found.select("doc_id", "held_out", "score", "predicted")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a test item, with the item and where."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text; a third of the ids is never learned from."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, held=1, cut=0.5)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: counts and a digest of the base kinds, and all spans."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; a fifth of the ids is never learned from."""
    return language(table(spark, sf_dir, "documents"), folds=5, held=0)


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and its source's target."""
    return mixed_words(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_texts(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths, with sums over all longer documents."""
    # Written, since the sums read it twice and each reading would encode all texts again.
    return suffix_sums(Stage(spark, "tokens").write(length_histogram(table(spark, sf_dir, "documents"))))


def op10_approximate_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest other rows of every row whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_secret_scans": op5_secret_scans,
    "op6_language_id": op6_language_id,
    "op7_mixing_sources": op7_mixing_sources,
    "op8_html_extraction": op8_html_extraction,
    "op9_token_counts": op9_token_counts,
    "op10_approximate_nearest": op10_approximate_nearest,
}

SQL: dict[str, str] = {
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
      FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * common >= 80 * (na + nb - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(c) AS component_id, s.doc_id = min(c) AS kept
FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, sh
""",
}

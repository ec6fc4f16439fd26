"""The corpus operators as registered queries: production parameters, whole tables, whole results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import decontaminate, ego_join, html_extract, importance, language_id, line_dedup, mixture, ngram_join, pii, quality, ranked_search, secret_scan, substring_dedup
from pairwright.llm.sql import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id: 3-word shingles, Jaccard of 0.9 or more."""
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: lines whose key is in 10 documents or more go."""
    done = line_dedup.drop_hot_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_spans, n_repeated, n_dropped, spans, partners of the documents with passages that others hold too."""
    return substring_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return language_id.identify(_table(spark, sf_dir, "documents"), ["doc_id"])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, cosine, subsequence, answered of the documents that hold benchmark passages."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: weights 5, 2, 1, 150% of all words, each document twice at most."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture.mix_to_targets(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept: cosine of 0.98 or more among equal labels."""
    return ego_join.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    return pii.scan(_table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted: quality as labels.quality marks it, predicted from a score of 0.3."""
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank: 5% of the documents of 20 words or more, drawn towards the benchmark's texts."""
    done = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_features", "weight", "score", "rank")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the ten best documents of each benchmark item."""
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_ngram_jaccard_join,
        op2_line_dedup,
        op3_substring_dedup,
        op4_language_id,
        op5_secret_scan,
        op6_html_extraction,
        op7_benchmark_decontamination,
        op8_mixture,
        op9_embedding_near_dedup,
        op10_pii,
        op11_quality,
        op12_importance_resampling,
        op13_ranked_search,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

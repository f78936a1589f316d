"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratersight.llm import branch_merge, decontamination, fingerprints, language, line_dedup, near_dedup, packing, quality, scratch, secrets, token_files, vector_codes, vector_dedup, web_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, through a ledger that starts empty."""
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents"), scratch.fresh(spark, "ledger")))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of 0.85 or more."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), near_dedup.Settings(words=3, percent=85))


def op3_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents' ids written to token files, and read back."""
    folder = scratch.fresh(spark, "tokens")
    manifest = token_files.write_tokens(_table(spark, sf_dir, "documents"), folder, tokenizer or public_tokenizers.path("word_bpe_49k.json"), 2)
    return token_files.read_tokens(spark, manifest, folder)


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that repeat, or nearly repeat, earlier ones: counts, and the digest of what is left."""
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "class_doc_id", "n_lines", "n_removed", "n_links", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to web archives, and read back."""
    folder = scratch.fresh(spark, "archives")
    return web_archives.read_archives(spark, web_archives.write_archives(_table(spark, sf_dir, "pages"), folder), folder)


def op7_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language.identify(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds."""
    return decontamination.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are."""
    return fingerprints.neighbours(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by integer codebooks, and their errors."""
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with a cosine of 0.95 or more."""
    return vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op13_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents after a three-way merge of the branches L and R, with clean changes and conflicts."""
    own = branch_merge.merge_coded(_table(spark, sf_dir, "documents"))
    return own.select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"), *branch_merge.COUNTS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scan, op2_minhash_near_dedup, op3_token_files, op4_quality_gam, op5_line_dedup, op6_web_archives, op7_language_crf, op8_best_fit_packing, op9_decontamination, op10_spotsigs, op11_vector_codes, op12_vector_dedup, op13_branch_merge)
}

ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": secrets.oracle_sql(),
    "op2_minhash_near_dedup": near_dedup.oracle_sql(near_dedup.Settings(words=3, percent=85)),
    "op6_web_archives": web_archives.oracle_sql(),
    "op11_vector_codes": vector_codes.oracle_sql(),
    "op12_vector_dedup": vector_dedup.oracle_sql(),
    "op13_branch_merge": branch_merge.oracle_sql(),
}

"""Documents to packed training sequences, in stages that are each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratersight.llm import decontamination, line_dedup, near_dedup, packing, quality, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go. Null and empty texts have a score as others do, repeated rows the same
    one; rows with a null id are judged by their text. Columns of any names stay. An empty table gives an empty one."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat, or nearly repeat, earlier ones go, and documents each of whose lines does; n_chars follows.

    A document from which something went and of which only white space is left goes; null, empty and blank texts of which
    nothing went stay. Of repeated rows, one keeps its lines. Columns that share a name with the operator's counts are the
    documents' own. Texts of any length are cut whole. An empty table gives an empty one."""
    names = tuple(_free(docs, n) for n in line_dedup.ADDED)
    marked, (_, n_removed, *_) = line_dedup.marked_lines(docs, names=names)
    cut = F.col(n_removed) > 0
    kept = marked.filter(~cut | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    while name in docs.columns:
        name += "_"
    return name


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, a similarity of 0.8 or more. Repeated rows
    and rows without an id are in their groups too."""
    return near_dedup.dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; repeated rows and rows with a null id are judged
    by their text. Columns of any names stay. An empty table gives an empty one."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces, with their places in sequences of 2048 tokens. A null or empty text is one piece of its
    end; repeated rows and rows with a null id have pieces of their own. Other columns go. An empty table gives no pieces."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("benchmark", benchmark_stage), ("packing", packing_stage)]

#: The stages can't be told in SQL; tests/llm/test_pipeline.py holds each one's decisions against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each does with odd rows stands there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs

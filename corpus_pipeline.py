"""A corpus pipeline of the operators in ledgerloom.llm: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns
of documents. See the operators for nulls, repeated rows and empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored
from ledgerloom.llm.decontaminate import with_hits
from ledgerloom.llm.jaccard import without_near_duplicates
from ledgerloom.llm.line_dedup import with_line_bitmaps
from ledgerloom.llm.packing import pack
from ledgerloom.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that an earlier document has; every document stays, with what is left of its text."""
    found = with_line_bitmaps(docs).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def near_duplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (runs of five words, Jaccard similarity of 0.8 or more) one row stays, with the smallest id."""
    return without_near_duplicates(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    found = with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out="_contamination")
    return found.where(F.col("_contamination")["n_hit"] == 0).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of token sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicate_documents),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The quality and the packing stage can't be stated in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus in five stages: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage is written as Parquet to the shared folder and read again as the next one's documents. All but the last
return the columns of documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import remove, work_path
from tessera.llm.decontaminate import clean
from tessera.llm.linededup import line_dedup
from tessera.llm.packing import pack
from tessera.llm.quality import CORPUS_RULES, quality_filter
from tessera.llm.simhash import near_dedup
from tessera.llm.tokens import default_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule keeps; being short is no fault here."""
    return quality_filter(docs, rules=CORPUS_RULES)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; a document with no line left goes."""
    return line_dedup(docs, drop_emptied=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8 or more."""
    return near_dedup(docs, shingle=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1,024-token sequences."""
    return pack(docs, tokenizer=default_path())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_copies),
    ("decontamination", decontaminate),
    ("packing", sequences),
]

#: Fingerprints, decontamination and byte-pair ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and reread."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs

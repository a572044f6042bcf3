"""A corpus, from documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet
and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from capstrata.llm import decontaminate, packing, quality, secrets, simhash
from capstrata.llm.common import read_table, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed limits and the calibrated classifier, with the columns they have.

    Null and empty texts fail; repeated rows are judged alike, rows without doc_id like others. No rows: none.
    """
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five words, similarity 0.8 or more): that of the smallest doc_id.

    Five-word SimHash fingerprints within two bits, found by pigeonring, are compared by whole sets first; as 64 bits
    cannot tell that similarity, the links that this leaves are then found exactly (see similar.py). Null and empty texts are one
    component; of repeated rows one stays; a row without doc_id stays only where its component has none with one.
    """
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each row judged by its own text; null and empty texts hold none."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents and rows, their secrets replaced by a mark and n_chars following; null texts stay null."""
    return secrets.redacted(docs, secrets.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences, with their ids. Null and empty texts are their end id; repeated rows are packed each."""
    return packing.pack_texts(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packed),
]

#: Trained models and tokenization have no SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; between stages the rows lie as Parquet in a new folder of the shared one."""
    jvm = spark.sparkContext._jvm
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{jvm.java.util.UUID.randomUUID()}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)

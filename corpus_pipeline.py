"""The corpus pipeline: STAGES in order, and run() over the documents of a folder.

Every stage takes whole documents and returns them with the same columns, but for the last, which returns pieces. Columns
of any other name, in any case and with dots, are carried along; an empty table gives an empty table of the same columns;
texts of any length are read whole; a null in any column but text changes nothing that a stage decides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cartomill.llm.common import deleted, shared_dir
from cartomill.llm.decontaminate import decontaminated
from cartomill.llm.langid import identified
from cartomill.llm.packing import pack
from cartomill.llm.pii import sanitised
from cartomill.llm.simhash import one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null and empty texts and texts without a letter. Repeated rows all stay."""
    return identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of least doc_id, of equal ids that of least text digest;
    rows without a doc_id come last. Null, empty and blank texts are one group; of repeated rows one stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; others lose long passages of the benchmark. Null and empty texts stay, and so does all
    against an empty benchmark."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and what discloses it are taken out of the texts; all documents stay, null texts as null."""
    return sanitised(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences; see the operator for the columns. A null text is empty: one end token."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]

#: SQL can express neither trained language models nor a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            deleted(spark, before)  # the next stage reads only what this one wrote
        docs, before = spark.read.parquet(path), path
    return docs

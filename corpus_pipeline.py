"""From raw documents to packed sequences: quality, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the columns of
documents: they drop rows (junk, copies) or put them in order (mixing), and change nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.llm.common import table, written
from framelake.llm.exact_dedup import exact_dedup
from framelake.llm.mixing import mixed
from framelake.llm.near_dedup import near_dedup
from framelake.llm.packing import pack_documents
from framelake.llm.quality import keep_good
from framelake.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rule ensemble scores under 0.5."""
    return keep_good(spark, docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (white space aside) keeps that with the smallest doc_id."""
    return exact_dedup(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles are alike to 0.8 or more keeps, group by group, that with the smallest doc_id."""
    return near_dedup(spark, docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in the order of a schedule that holds every source to its weight; the files keep the order."""
    return mixed(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' ids into sequences of at most 4096, window by window of the mixed order, and numbers them by it."""
    return pack_documents(spark, docs, vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096, scheduled=True)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: The near-dedup and packing stages are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs

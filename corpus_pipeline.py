"""A training corpus from ``documents``: rules, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the
last return the columns that came in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lagwise.llm.common import prepare, read
from lagwise.llm.exact_dedup import drop_copies
from lagwise.llm.mixing import mixed_documents
from lagwise.llm.packing import pack_documents
from lagwise.llm.quality_rules import keep_good
from lagwise.llm.simhash import keep_one
from lagwise.llm.workload import packing_tokenizer
from lagwise.session import passing, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the current policy (operator 10)."""
    prepare(spark)
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id (operator 6)."""
    prepare(spark)
    return drop_copies(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component, the document with the smallest doc_id (operator 8)."""
    prepare(spark)
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents left out, kept, or repeated up to three times (operator 2)."""
    prepare(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their places in sequences (operator 7)."""
    prepare(spark)
    return pack_documents(docs, packing_tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; scratch tables and results of a stage go when the next one is stored."""
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs, path = passing(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        release(spark, before)
        before = [path]
    return docs


# SimHash, seeded selection and a tokenizer are beyond SQL; tests/llm has a plain version.
ORACLE_SQL = None

"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), is written as Parquet and is read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm import minhash, mixing, packing, pii, quality
from pricewright.llm.scratch import Scratch


#: Words of a shingle, as in op8_minhash: more copies are caught than by five.
SHINGLE = 2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects, unchanged. Null and empty texts go (too few words), null
    languages and sources are groups of their own, equal rows are judged alike."""
    return quality.judge(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by the shingles of op8_minhash: the one
    with the smallest doc_id, one row of repeated ones. Null and empty texts are in no group
    and stay."""
    return minhash.one_of_each(docs, shingle=SHINGLE)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data masked; n_chars follows the text. A null text stays
    null, repeated rows all stay."""
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Null sources are one source, the
    last; repeated rows draw keys of their own; a document without words is taken as its key has it."""
    return mixing.mixed_rows(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences. A null text is an empty one:
    a piece of one id; repeated rows are documents of their own."""
    return packing.packed(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_duplicates),
    ("pii", personal_data),
    ("mix", source_mix),
    ("pack", sequences),
]

#: SQL cannot cut texts into tokens; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order over all documents; an empty table gives an empty one."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from ``documents``: five stages, each an operator of ``tidewatch.llm`` over all its predecessor kept.

All stages take an empty table and give one; columns whose names the operators use themselves come through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import bpe, decontaminate, linededup, probminhash, quality
from tidewatch.llm.common import materialise, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go.

    A null or empty text fails the rules; a null host has no verdict; repeated rows each stay or go by themselves; a very long text is measured in its row.
    """
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the last of them; the others' texts lose them.

    Null and empty texts stay as they are, and so does a text that loses no line; rows that share an id (null is one) count as one document; equal rows lose the same lines.
    """
    return linededup.dedup_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays.

    A null id is the least; of rows equal in id and text one stays; texts without words are nobody's duplicates and all stay; other texts of one id are told apart by 128 bits.
    """
    return probminhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts stay; repeated rows stay or go together; items without words hold no window; a very long text is hashed in slices.
    """
    return decontaminate.remove(docs, read_table(spark, sf_dir, "benchmark"), mode="documents")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the text that they decode to.

    A null or empty text has no ids; repeated rows each give a row; a very long text is encoded chunk by chunk.
    """
    return bpe.encode(docs, decoded=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminated),
    ("bpe", bpe_encoding),
]

#: SQL can't express the tokenizer: tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)

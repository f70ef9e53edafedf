"""A corpus pipeline of the llm operators: language, copies, near copies, mixture, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import exact_dedup, language_id, mixing, sentencepiece_scan, simhash
from loomspan.llm.common import shared_checkpoint, table

#: Each function takes (spark, docs, sf_dir) and returns what the next one gets as docs. All but the
#: last return the columns of documents.
STAGES = [
    ("language ID", language_id.stage),
    ("exact dedup", exact_dedup.stage),
    ("SimHash near-dedup", simhash.stage),
    ("mixing sources", mixing.stage),
    ("SentencePiece", sentencepiece_scan.stage),
]
#: SQL cannot express the stages; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each on all that the one before kept.

    Rows are told apart by their place in a stage's input, so each result but the last is written to
    the shared checkpoint folder, and the next stage reads that.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared_checkpoint(docs)
    return docs

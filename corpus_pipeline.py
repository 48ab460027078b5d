"""A training corpus from raw documents: toxicity filter, line deduplication, near-deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it kept, and returns a DataFrame; all but the last return the columns
of documents. A stage judges its own input and its decisions take effect: documents that it rejects are gone from the stages after it.

A null text counts as an empty one and stays null until it is packed. Documents without a doc_id are judged by their text alone and are no one's
near-duplicate; rows that repeat a doc_id with the same text are one document after the third stage. Columns beyond those of documents are kept up to the
fourth stage, whatever their names. An empty table gives no piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.llm import decontaminate, line_dedup, packing, simhash, toxicity
from citegrain.llm.common import settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on those of them that are labelled, does not reject."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their site's boilerplate lines; n_chars, if there is one, is that of the text that is left. Copies are a later stage's
    concern: pages of one text count as one page here, so that a page does not lose its own lines by being copied."""
    cleaned = line_dedup.drop_boilerplate(docs, copies_once=True)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.digest(packing.pack_documents(docs))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash", drop_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: The stages learn, fingerprint and tokenise, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs

"""A corpus pipeline of five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``, further ones
included, whatever their names. The last returns the packed pieces. The tokeniser puts the pipeline beyond SQL, so
``ORACLE_SQL`` is None and the tests compare it with a brute-force version. An empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, ngram_join, packing, personal_data, quality_rules
from tessera.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of quality rules rejects go: null and empty texts, which have no words, among them.

    Rows are judged one by one, so repeated rows stay or go together, and null ids don't matter.
    """
    return quality_rules.apply_policy(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of 0.8 Jaccard similarity or more connect, the one of the smallest id stays.

    Rows of one id are one document and stay or go together. Rows of a null id, and texts without words, link with nothing and stay.
    """
    scratch = Scratch(spark, "near-duplicates")
    gone = scratch.write(ngram_join.link(docs, scratch).where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one within its error budget, go, with all rows of their id.

    Null and empty texts hold none, and rows of a null id stay.
    """
    scratch = Scratch(spark, "decontamination")
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), scratch)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and n_chars, if there is such a column, counts the new text. No row goes.

    Null and empty texts stay as they are; repeated rows are changed alike.
    """
    scratch = Scratch(spark, "redaction")
    clean = personal_data.redact(docs, scratch)
    counted = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean
    return counted


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, cut into sequences of 4096. Null and empty texts are one end token, repeated rows are packed each."""
    scratch = Scratch(spark, "packing")
    return packing.pack(docs, scratch)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("personal_data", redact), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs)
    return docs

"""Corpus pipeline: language ID, SimHash near-dedup with an exact check, decontamination, personal data, mixing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and reread as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, jaccard, langid, mixing, pii
from tracelake.llm.common import shared_dir, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (`und`): null texts and texts without any letter."""
    named = langid.identify(docs, langid.fit(docs), out=("_lang_pred", "_lang_score"))
    return named.where("_lang_pred <> 'und'").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Links texts whose sets of five-word shingles have Jaccard similarity 0.8 at least: proposed by fingerprints and, where these are too
    far apart, by a prefix filter, all verified. Null, empty and blank texts link to each other. Keeps the document with the smallest id of each component; of rows that repeat this id, one. Rows without an id go: nothing could name them."""
    found = jaccard.near_duplicates(docs).where("id = component").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(found, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of any benchmark item; op1's column asks for two items, a stage that cleans for one.
    Null and empty texts hold none; of rows that repeat an id all go if one does; rows without an id stay, as nothing names them."""
    bad = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), min_items=1).where("contaminated").select("doc_id")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the text; n_chars, where there is one, follows the new text. Every row stays; null texts stay null."""
    found = pii.redact(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else found


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document; a row each, also for null texts, ids and sources."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminated", decontaminated),
    ("personal_data", personal_data),
    ("mixed", mixed),
]

#: Language scores, shingle hashes and trees have no SQL twin; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents."""
    docs = table(spark, sf_dir, "documents")
    base = shared_dir(spark)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"{base}/{name}")
    return docs

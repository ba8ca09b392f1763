"""From raw documents to packed training bins: language ID, near-dedup, decontamination, PII, packing.

For every stage: repeated rows stay or go alike, texts are taken whole however long, an empty table stays empty, and
columns of any other name pass through but for the last stage, which says where pieces of documents go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.llm import common, decontaminate, langid, packing, pii, simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without text (null or empty) or letters, of a script not learned or of a score near chance go."""
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group of near copies; null and blank texts are one group, rows without doc_id stay."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item is found; those with null or empty text stay."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null and empty texts as they are."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; one without words, be it null or empty, has a row without a bin."""
    return packing.best_fit(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packed)]

#: No SQL expresses a trained network or best-fit packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage has read is deleted once its result is written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.stage(docs, f"pipeline-{name}")
            if before is not None:
                common.discard(before)
            before = docs
    return docs

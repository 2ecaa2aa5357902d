"""A corpus pipeline of five stages: language, quality, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, as it leaves them;
the last returns packed pieces. run() writes each stage's result as Parquet below the shared
folder and reads it back for the next.

What odd inputs give, stage by stage. Null or letterless text: rejected by language (by quality as
well, for having no words; near duplicates take it as fingerprint zero, personal data leaves it null,
packing gives it its end alone). Empty table: no rows. Very long texts: whole in every stage. Repeated
rows: one of them is kept by near duplicates, each of them by the others. Ties: the least id of a group
stays. Extra columns, whatever their names: carried as they are by all stages but the last, which
returns pieces only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempora.llm import langid, packing, pii, quality, simhash
from tempora.llm.common import materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that language identification does not reject."""
    return langid.accepted(docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and the isolation forest."""
    return quality.judge(docs, table(spark, sf_dir, "labels"), only_kept=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each near-duplicate group."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' ids into sequences."""
    return packing.pack(docs)


STAGES = [("language", language), ("quality", rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packed)]

#: Its models and hashes are not expressible in SQL; tests/llm compares it with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

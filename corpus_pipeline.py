"""Corpus cleaning: quality rules, toxicity, near-duplicates, personal data, packing; each stage reads the last one's table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.llm import near_duplicates as near_duplicates_of
from gatewarden.llm import packing, pii, quality_rules, toxicity
from gatewarden.llm.common import free, released, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject; the rules are learned from the labelled documents of ``sf_dir``."""
    rules = quality_rules.fit(quality_rules.training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    to = free(docs, "quality")
    return quality_rules.judge(docs, rules, to=to).filter(F.col(to)["kept"]).drop(to)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored as toxic; the examples are the labelled documents of ``sf_dir``."""
    index = toxicity.model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    to = free(docs, "toxicity")
    return toxicity.score(docs, index, to=to).filter(F.col(to)["predicted"] == 0).drop(to)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts linked by a similarity of 0.8 or more over five-word shingles."""
    return near_duplicates_of.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts pseudonyms in the place of personal data; they keep their values' lengths, so n_chars stays right."""
    return pii.pseudonymised(docs, pii.KEY, to=None)


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: bins of several lengths, in UTF-8 bytes."""
    return packing.packed(docs.select("doc_id", packing.byte_length(F.col("text")).alias("length")))


STAGES = [
    ("quality_rules", quality),
    ("toxicity", toxic),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", packing_plan),
]

#: Learned models and bin packing are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over ``documents``, each written as Parquet in the shared folder and read again; a stage's
    table goes once the next one's is there."""
    docs = source = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = written(stage(spark, docs, sf_dir), name)
        if docs is not source:
            released(docs)
        docs = made
    return docs

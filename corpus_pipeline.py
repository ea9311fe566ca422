"""From raw documents to packed training sequences: language, toxicity, near duplicates, mix, packing.

Each stage takes (spark, docs, sf_dir); its result is written and read again as the next one's docs. The first four
return documents with the columns they got; the last returns the pieces of sequences. Language ID drops texts without
a letter and such whose best language is hardly likelier than a guess among the learned ones; toxicity drops what it predicts to be toxic; of each group
of near duplicates the document with the smallest doc_id stays; mixing repeats or leaves out documents of each source
until its target is met, in training order, and cuts the one document at which a target ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import language_id, mixing, near_dup, packing, toxicity
from foliant.llm.queries import table, tokenizer_path
from foliant.llm.shared import release, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs)


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", known_language), ("toxicity", ordinary), ("near_dup", distinct), ("mixing", mixed), ("packing", packed)]
#: No stage but the mix can be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            release(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training-corpus pipeline over `documents`: each stage reads what its predecessor wrote.

Stages, in order: language identification drops documents without a known language; near-duplicate detection leaves
one document of each group; personal data are replaced in the texts; documents are repeated or left out to meet
target weights of quality and toxicity; what is left is encoded as token ids.

Every function takes (spark, docs, sf_dir), keeps all rows that its operator keeps, and returns the columns of docs;
the last one returns doc_id, token_ids and digests. Null texts have no language and go with the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwright.llm import bpe, lang_id, mixing, near_dedup, pii
from tarnwright.llm.common import materialise
from tarnwright.llm.queries import table, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select("doc_id", mixing.quality_domain().alias("domain"))
    return mixing.drawn(docs, labelled)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(docs, tokenizer_path())


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixture),
    ("bpe", tokens),
]

#: The network, trees, sketches and merges of the stages have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs

"""The pipeline over documents: each stage reads all that its predecessor kept.

Missing texts count as empty. A stage's decisions take effect in the rows it returns: rejected
documents and all but one of each near-duplicate class go, documents with benchmark passages go,
secrets are masked, and what is left is packed. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import dartminhash, decontaminate, packing, quality, secrets, tokens
from tapeloom.llm.queries import OWNER, OWNERSHIP, REPOSITORY, WORD_VOCABULARY
from tapeloom.llm.rows import staged, table


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dartminhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_matches(docs, table(spark, sf_dir, "benchmark"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask(docs, OWNER, REPOSITORY, OWNERSHIP)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents with their ids and their places in sequences."""
    return packing.pack(docs, packing.Packing(tokens.public_file(WORD_VOCABULARY), with_ids=True))


STAGES = [
    ("quality classifier", judge),
    ("MinHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminated),
    ("secret scans", mask),
    ("packing", pack),
]

# Models and tokenizers are beyond SQL. A test holds run()'s documents, masked texts and ids against a plain
# version of every stage (the fitted weights are taken as they are); stages have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs

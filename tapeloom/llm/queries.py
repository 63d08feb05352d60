"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import (
    dartminhash,
    decontaminate,
    idfiles,
    importance,
    licenses,
    packing,
    quality,
    repeats,
    rules,
    secrets,
    spelling,
    tokencounts,
    tokens,
    urls,
)
from tapeloom.llm.rows import table

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
# The rules of the url filter.
URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]
# A source owns its documents, and each document is a repository: both are counted, owners alone decide.
OWNER, REPOSITORY = "source", "doc_id"
OWNERSHIP = secrets.Ownership(repositories=None)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, OWNER, REPOSITORY, OWNERSHIP)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = packing.Packing(tokens.public_file(WORD_VOCABULARY))
    return packing.pack(table(spark, sf_dir, "documents"), cfg)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.public_file(PIECE_VOCABULARY)
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), path)


def op6_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.classes(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.matches(docs, items)


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(docs, labels)


def op10_idfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = idfiles.IdFiles(tokens.public_file(BYTE_VOCABULARY))
    return idfiles.round_trip(table(spark, sf_dir, "documents"), cfg)


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    rows = importance.resample(docs, target)
    return rows.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_packing": op2_packing,
    "op3_licenses": op3_licenses,
    "op4_urls": op4_urls,
    "op5_tokencounts": op5_tokencounts,
    "op6_dartminhash": op6_dartminhash,
    "op7_decontaminate": op7_decontaminate,
    "op8_rules": op8_rules,
    "op9_quality": op9_quality,
    "op10_idfiles": op10_idfiles,
    "op11_repeats": op11_repeats,
    "op12_importance": op12_importance,
    "op13_spelling": op13_spelling,
}

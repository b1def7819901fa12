"""Corpus pipeline: documents pass one stage after another, each written as Parquet and read again.

All stages take null and empty texts (which the first one drops for want of words), very long texts, null ids and sources, and
extra columns, whose names may clash with those that a stage adds for itself. Repeated rows are judged alike; of fully equal
rows near-duplicates keep one. An empty table passes every stage as an empty table.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendframe.llm import bpe, bytenet, decontaminate, host_rules, simhash
from spendframe.llm.common import fresh_name, table
from spendframe.llm.queries import QUALITY_THRESHOLD, quality_network, tokenizer_path
from spendframe.session import durable, new_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or whose host fails as a whole."""
    whole = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    measured = host_rules.measure(docs.select(whole.alias("row"), F.col("source"), F.col("text"))).drop("text")
    # Both the hosts' rates and the verdicts read the measures, so they are stored with their rows.
    return host_rules.judge(durable(measured, "pipeline-measures")).where("kept").select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the network, learned from labelled rows of this stage's input, scores below the threshold."""
    network = quality_network(docs, table(spark, sf_dir, "labels"))
    score = fresh_name(docs, "quality_score")
    return bytenet.predict(docs, network, "text", score).where(F.col(score) >= QUALITY_THRESHOLD).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each SimHash group."""
    return simhash.keep_first(docs, "doc_id", "text", size=3, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    leaks = fresh_name(docs, "leaks")
    return decontaminate.find(docs, table(spark, sf_dir, "benchmark"), "text", leaks).where(F.size(leaks) == 0).drop(leaks)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with their number and the digest of the text they decode to."""
    path = tokenizer_path()
    # Ids are stored before they are decoded: in one plan, each batch would be encoded twice and hold text, ids and decoded text at once.
    ids = durable(bpe.encode(docs.select("doc_id", "text"), path).select("doc_id", "ids"), "pipeline-ids")
    coded = bpe.decode(ids, path)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

# The classifier, fingerprint and tokenizer stages cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

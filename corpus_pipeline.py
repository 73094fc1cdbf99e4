"""A training corpus from raw documents: classify, rule out, deduplicate, decontaminate, encode.

Cases, in all stages: a null text counts as empty; very long texts are worked on whole; repeated rows are worked on each,
but for near-dedup, which keeps one row of a doc_id; ties fall as the operators say; an empty table stays empty; further
columns pass through all stages but the last, also under names that the operators use. What each stage makes of a text
without words stands in its function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthcal.llm import byte_bpe, decontaminate, near_dedup, quality_classifier, quality_rules
from depthcal.llm.common import materialize, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier keeps. A text without words is scored like any other; without labels of
    both kinds everything is kept."""
    return quality_classifier.filter_quality(docs, quality_classifier.fit_quality(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; those of fewer than 20 words, so also null and empty texts, fail."""
    return quality_rules.filter_rules(docs, quality_rules.trusted(table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more. The least doc_id stays; texts
    without words and rows without a doc_id are in no group and stay."""
    return near_dedup.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; texts without words have none and stay."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of the documents, and a digest of the bytes that they decode to; a null or empty text has no ids."""
    rows = byte_bpe.production().encode(docs, keep=["doc_id"], data="data", raw="raw")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("data", 256).alias("decoded_sha256"))


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("near_dedup", deduplicate), ("decontamination", decontaminated), ("byte_bpe", encode)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

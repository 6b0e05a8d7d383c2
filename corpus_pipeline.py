"""A training corpus from raw documents: five stages, each on all that the one before it kept.

1. ``quality_rules``: documents that the rules of policy v1 reject go.
2. ``near_dedup``: of each group of documents that share 0.8 or more of their five-word runs one stays.
3. ``decontaminate``: documents that hold a benchmark window go.
4. ``secret_scan``: live-looking, owner-specific credentials are replaced in the text.
5. ``encode``: token ids of what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm import bpe, decontaminate, near_dup, quality, secrets
from tracklens.llm.common import quoted, staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    led = quality.ledger(docs.select(*COLUMNS))
    return led.filter(quality.passes("v1")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 of their five-word runs join, the one with the smallest id stays; of repeated rows of it, one."""
    return near_dup.one_of_each(docs.select(*COLUMNS))


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scan(docs.select(*COLUMNS), F.concat_ws("/", "source", "lang"), quoted("source"), keep=COLUMNS, whole=True)
    cleaned = secrets.redact(found)
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs.select(*COLUMNS), keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", remove_benchmarks),
    ("secret_scan", secret_scan),
    ("encode", encode),
]

#: Byte-level BPE is not expressible in SQL; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

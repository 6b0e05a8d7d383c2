"""Exact deduplication against a persistent index of digests.

The index is a table bucketed and sorted by digest: one row for each text seen, with the row that
stays for it. An arrival is reduced to its distinct digests, the known ones go by a sort-merge
anti-join in which the index is not shuffled, and the rest is appended. A text's first arrival
keeps its place for good, so a catalogue that is loaded by ascending id keeps the smallest.

Only digests move, never texts, and copies meet as counts that are combined before the shuffle.
An append is one Spark write: it is there as a whole or not at all, and an arrival
that is added again finds its digests known and adds none.

Defined results: a null text counts as empty; of equal texts the smallest id stays, a null id only
if there is no other; of repeated rows of that id one stays; repeated rows are repeated in the
result; an empty table gives an empty result; columns that are named as results give way to them.
"""

from __future__ import annotations

import atexit
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm.common import join_counted, new_path, quoted, staged

BUCKETS = 16


def normalized(text: Column) -> Column:
    """The text with one blank for every run of white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalized(text), 256))


@dataclass(frozen=True)
class DigestIndex:
    """``(digest, keep_id)``: every digest once, with the id that stays for it."""

    spark: SparkSession
    name: str
    path: str
    id_type: str = "bigint"
    buckets: int = BUCKETS

    def create(self) -> DigestIndex:
        """Makes the table, or takes over the files that an earlier session left at its path."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {self.id_type}) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        return self

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def new(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index does not hold."""
        return groups.join(self.rows().hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Adds ``(digest, keep_id)`` of new digests; each digest stands once in ``groups``."""
        rows = self.new(groups).select("digest", "keep_id").repartition(self.buckets, "digest")  # one file for each bucket
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def drop(self) -> None:
        """Takes the table out of the catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _ended(index: DigestIndex) -> None:
    if index.spark.sparkContext._jsc is not None:
        index.drop()


def temporary_index(spark: SparkSession, id_type: str = "bigint") -> DigestIndex:
    """An empty index in the shared folder, for as long as this process runs."""
    index = DigestIndex(spark, f"digests_{uuid.uuid4().hex}", new_path(spark, "digests"), id_type).create()
    atexit.register(_ended, index)
    return index


def arrivals(groups: DataFrame) -> list[DataFrame]:
    """The groups in two arrivals: the lower half of the range of their ids, then the upper half and those without id."""
    middle = groups.agg(F.floor(F.min("keep_id") / 2 + F.max("keep_id") / 2).alias("m")).first()["m"]
    early = F.coalesce(F.col("keep_id") <= F.lit(middle), F.lit(False))
    return [groups.filter(early), groups.filter(~early)]


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``, for every row of ``docs``.

    The texts arrive at ``index`` by ascending id. ``group_size`` counts the rows of ``docs``. A text that the index
    holds under another id is not kept again; one that it holds under the same id is, so that a run that was lost can be done again.
    """
    made = ("keep_id", "group_size", "kept", "text_sha256")
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    rows = docs.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(names)], quoted(id_col).alias("id"), digest(quoted(text_col)).alias("digest"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "digests-of-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row"))
    groups = staged(rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size")), "digests-of-texts")
    for arrival in arrivals(groups.select("digest", F.col("first.id").alias("keep_id"))):
        index.append(arrival)
    found = groups.join(index.rows().hint("merge"), "digest")
    joined = join_counted(rows, found, "digest", "group_size", rows.count())
    return joined.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(names)],
        "keep_id", "group_size", ((F.col("row") == F.col("first.row")) & F.col("keep_id").eqNullSafe(F.col("first.id"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )

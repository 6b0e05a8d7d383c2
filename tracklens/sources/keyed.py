"""A table stored by key bucket: an update reads, joins and writes only the buckets that it touches.

Files lie in ``data/<version>/bucket=<n>``. A small file in ``versions`` names, for every bucket, the folder
that holds it; it is renamed into its place last, so a reader sees all of an update or nothing, a run that dies
leaves nothing but files that nobody names, and of two writers the second fails. Files of other buckets stay as they are.

Defined results: a row without a key is in bucket 0 and is never met by an update; of several updates
of a key the first by its values counts; an update that meets no row rewrites nothing; a table may be empty.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklens.operators import relational as rel
from tracklens.sources.staging import mark, marked, names_in, removed, written


class KeyedTable:
    """``buckets`` is fixed when the table is made; it is what one update rewrites at least, as a share of the table."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, buckets: int = 64) -> KeyedTable:
        table = cls(df.sparkSession, path)
        first = {"key": key, "buckets": buckets, "schema": df.schema.json(), "folders": {}}
        return table._commit(first, df, [], 0)

    def _last(self) -> int:
        return max(int(n) for n in names_in(self.spark, f"{self.path}/versions") if n.isdigit())

    def manifest(self) -> dict:
        return json.loads(marked(self.spark, f"{self.path}/versions/{self._last()}"))

    def _bucket(self, m: dict, df: DataFrame) -> Column:
        typed = F.col(m["key"]).cast(T.StructType.fromJson(json.loads(m["schema"]))[m["key"]].dataType)
        return F.when(typed.isNull(), 0).otherwise(F.pmod(F.xxhash64(typed), F.lit(m["buckets"]))).cast("int")

    def _commit(self, m: dict, rows: DataFrame, touched: list[int], at: int) -> KeyedTable:
        """Writes the rows as new folders in place of those of the buckets touched, then the list of folders."""
        folder = f"data/{at}-{uuid.uuid4().hex}"
        # Buckets of any size become files of an even one: the planner splits large ones and joins small ones.
        rows.withColumn("bucket", self._bucket(m, rows)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        kept = {b: f for b, f in m["folders"].items() if int(b) not in touched}
        new = {n.removeprefix("bucket="): folder for n in names_in(self.spark, f"{self.path}/{folder}") if n.startswith("bucket=")}
        mark(self.spark, f"{self.path}/versions/{at}", json.dumps(m | {"folders": kept | new}))
        return self

    def _read(self, m: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        at = [f"{self.path}/{f}/bucket={b}" for b, f in m["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The table as it is now; later updates do not change what was read."""
        return self._read(self.manifest())

    def lookup(self, keys: list) -> DataFrame:
        """The rows of some keys; only their buckets are read, and of those what the keys' statistics leave."""
        m = self.manifest()
        asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(m["key"], T.StructType.fromJson(json.loads(m["schema"]))[m["key"]].dataType)]))
        own = [r[0] for r in asked.select(self._bucket(m, asked)).distinct().collect()]  # at most one for each key asked
        return self._read(m, own).filter(F.col(m["key"]).isin(keys))

    def _rewrite(self, changes: DataFrame, make: Callable[[DataFrame, DataFrame], DataFrame], missing: bool = False) -> list[int]:
        m, at = self.manifest(), self._last()
        changes = written(changes.filter(F.col(m["key"]).isNotNull()).withColumn("_bucket", self._bucket(m, changes)), "changes")
        touched = sorted(r[0] for r in changes.select("_bucket").distinct().collect() if missing or str(r[0]) in m["folders"])  # numbers of buckets
        if touched:
            self._commit(m, make(self._read(m, touched), changes.drop("_bucket")), touched, at + 1)
        return touched

    def update(self, updates: DataFrame, policy: dict[str, str]) -> list[int]:
        """As ``relational.apply_updates``; returns the buckets that were written."""
        key = self.manifest()["key"]
        return self._rewrite(updates, lambda base, own: rel.apply_updates(base, own, key, policy))

    def insert(self, new: DataFrame) -> list[int]:
        """Adds the rows whose key is not there yet, as ``relational.insert_ignore``; rows without a key are left out."""
        key = self.manifest()["key"]
        return self._rewrite(new, lambda base, own: base.unionByName(rel.insert_ignore(own, base, key).select(*base.columns)), missing=True)

    def delete(self, keys: DataFrame) -> list[int]:
        """Takes out the rows with these keys."""
        key = self.manifest()["key"]
        return self._rewrite(keys.select(key), lambda base, own: base.join(own.distinct(), key, "left_anti").select(*base.columns))

    def vacuum(self) -> list[str]:
        """Removes the folders that the table as it is now does not name; nobody may still read an older version, or write."""
        named = set(self.manifest()["folders"].values())
        old = [f for n in names_in(self.spark, f"{self.path}/data") if (f := f"data/{n}") not in named]
        for f in old:
            removed(self.spark, f"{self.path}/{f}")
        return old

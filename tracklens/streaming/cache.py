"""Requests that a cached answer served are dropped, batch by batch of a stream.

An answer serves its key for ``ttl`` from the request that filled the cache, so of a key's
requests the first is kept, then always the next at least ``ttl`` later. A batch is first reduced to one
request for each key and millisecond, before rows move, so that a key's rows are bounded by the time that the batch
spans and not by the traffic. Sorted rows then pass one by one: what is held of a key is one time.

State is the filling time of each key whose answer still lives when the batch's last request comes, less the lateness allowed; it
is written with the batch's results in one write under the batch's number. A batch that is run again reads the state of the one
before it and replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.sources.staging import names_in

#: Seconds for which a request of a kind is answered from the cache.
TTL = {"search": 300, "versions": 300, "stats": 60}
_PASSED = "key string, ms long, event_id long, kept boolean"


def _pass(batches: Iterator[pa.RecordBatch], ttl: int) -> Iterator[pa.RecordBatch]:
    """Of rows by key and time, with a key's state (no ``event_id``) before its requests: the kept ones, and the last filling time of each key."""
    key: str | None = None
    first: int | None = None
    for batch in batches:
        keys, ms, ids = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
        runs, state, out = keys.to_pylist(), np.asarray(ids.is_null()), []
        cuts = [0, *[i for i in range(1, len(runs)) if runs[i] != runs[i - 1]], len(runs)]
        for a, b in zip(cuts, cuts[1:]):
            if b == a:
                continue
            if first is None or runs[a] != key:
                if first is not None:
                    out.append((key, first, None, False))
                key, first = runs[a], None
            at = a
            if state[at]:
                first, at = int(ms[at]), at + 1
            while at < b:
                if first is not None:
                    at += int(np.searchsorted(ms[at:b], first + ttl))
                    if at == b:
                        break
                first = int(ms[at])
                out.append((key, first, ids[at].as_py(), True))
        yield pa.RecordBatch.from_pylist([dict(zip(("key", "ms", "event_id", "kept"), r, strict=True)) for r in out], schema=_ARROW)
    if first is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "ms": first, "event_id": None, "kept": False}], schema=_ARROW)


_ARROW = pa.schema([("key", pa.string()), ("ms", pa.int64()), ("event_id", pa.int64()), ("kept", pa.bool_())])


def passed(requests: DataFrame, ttl_seconds: int, before: DataFrame | None = None) -> DataFrame:
    """Kept requests ``(key, ms, event_id)`` and, with ``kept`` false, the last filling time of every key; ``before`` is that of earlier rows."""
    rows = requests.groupBy("key", "ms").agg(F.min("event_id").alias("event_id"))
    if before is not None:
        rows = rows.unionByName(before.select("key", "ms", F.lit(None).cast("long").alias("event_id")))
    # A key's state is earlier than its requests in time; where they are equal or late, it still comes first.
    rows = rows.repartition("key").sortWithinPartitions("key", F.col("event_id").isNotNull(), "ms", "event_id")
    ttl = ttl_seconds * 1000
    return rows.mapInArrow(lambda batches: _pass(batches, ttl), _PASSED)


def cached_dedup(requests: DataFrame, ttl_seconds: int = TTL["search"]) -> DataFrame:
    """``(key, event_id)`` of a table ``(key, ms, event_id)`` without the requests that a cached answer served."""
    return passed(requests, ttl_seconds).filter("kept").select("key", "event_id")


@dataclass(frozen=True)
class CachedDedup:
    """The same for a stream: ``process`` is its ``foreachBatch`` function."""

    spark: SparkSession
    path: str
    ttl_seconds: int = TTL["search"]
    lateness_seconds: int = 0

    def process(self, batch: DataFrame, number: int) -> None:
        last = batch.agg(F.max("ms")).first()[0]
        before = self.state(number - 1)
        rows = passed(batch, self.ttl_seconds, before)
        if last is not None:
            lives = F.col("ms") + self.ttl_seconds * 1000 > F.lit(last - self.lateness_seconds * 1000)
            rows = rows.filter(F.col("kept") | lives)
        rows.write.mode("overwrite").partitionBy("kept").parquet(f"{self.path}/batch={number}")

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], _PASSED)
        return self.spark.read.schema(_PASSED).option("basePath", self.path).parquet(*[f"{self.path}/{n}" for n in names]).select("key", "ms", "event_id", "kept")

    def state(self, number: int) -> DataFrame:
        """``(key, ms)`` of the answers that live on after a batch."""
        name = f"batch={number}"
        return self._read([f"{name}/kept=false"] if "kept=false" in names_in(self.spark, f"{self.path}/{name}") else []).select("key", "ms")

    def kept(self) -> DataFrame:
        """The kept requests of all batches."""
        numbers = [n for n in names_in(self.spark, self.path) if n.startswith("batch=")]
        return self._read([f"{n}/kept=true" for n in numbers if "kept=true" in names_in(self.spark, f"{self.path}/{n}")]).select("key", "event_id")

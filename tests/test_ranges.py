"""Windows on times: pairs, totals and pages against brute force, and what a hot time does to the parts."""

import random

from pyspark.sql import functions as F

from tracklens import queries as q
from tracklens.operators import ranges

SHAPE = "query_id long, min_ms long, max_ms long"


def _rows(seed: int, n: int) -> list[tuple]:
    """A third of all rows has one time, some have none, one is far away from all others."""
    r = random.Random(seed)
    rows = [(i, 180_000 if i % 3 == 0 else None if i % 17 == 0 else r.randrange(0, 900_000)) for i in range(n)]
    return [*rows, (n, 4_000_123)]


def _windows(seed: int) -> list[tuple]:
    r = random.Random(seed)
    found = [(0, None, None), (1, 180_000, 180_000), (2, 5_000_000, None), (3, 10, 5), (4, None, 0), (5, 4_000_123, 9_000_000), (6, 179_999, None), (7, None, 180_001), (8, -50, -1)]
    return found + [(9 + i, low, low + r.choice([0, 80, 999, 1000, 299_999, 300_001, 700_000])) for i, low in enumerate(r.randrange(0, 900_000) for _ in range(25))]


def _want(windows, rows):
    top = max((d for _, d in rows if d is not None), default=0)
    inside = lambda w, d: d is not None and (0 if w[1] is None else w[1]) <= d <= (top if w[2] is None else w[2])
    return {w[0]: [i for d, i in sorted((d, i) for i, d in rows if inside(w, d))] for w in windows}


def test_pairs_totals_and_pages(spark):
    for seed, n in ((1, 400), (2, 3)):
        rows, windows = _rows(seed, n), _windows(seed)
        t, w = spark.createDataFrame(rows, "id long, duration_ms long"), spark.createDataFrame(windows, SHAPE)
        want = _want(windows, rows)
        pairs = sorted((r.query_id, r.id) for r in ranges.range_join(w, t).collect())
        assert pairs == sorted((k, i) for k, own in want.items() for i in own)
        totals = {r.query_id: r.total for r in ranges.window_totals(w, t).collect()}
        assert totals == {k: len(own) for k, own in want.items()}
        got = ranges.window_page(w, t, 2, 7).collect()
        assert sorted((r.query_id, r.position, r.total, r.id) for r in got) == sorted((k, p, len(own), i) for k, own in want.items() for p, i in enumerate(own, 1) if 7 < p <= 14)


def test_pairs_of_one_file_are_made_by_several_tasks(spark, tmp_path):
    """2,000 tracks lie in one file, a third with one time; no task makes more than half of the pairs."""
    spark.createDataFrame(_rows(4, 2000), "id long, duration_ms long").coalesce(1).write.parquet(f"{tmp_path}/t")
    spark.createDataFrame([(i, None, None) for i in range(20)], SHAPE).coalesce(1).write.parquet(f"{tmp_path}/w")
    t, w = spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/w")
    made = [r["count"] for r in ranges.range_join(w, t).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 20 * t.filter("duration_ms IS NOT NULL").count() and max(made) < sum(made) / 2


def test_no_table_of_pairs_is_broadcast(spark, tmp_path):
    """Tracks and windows of a small file are many rows: neither goes through the driver."""
    spark.createDataFrame(_rows(5, 500), "id long, duration_ms long").coalesce(1).write.parquet(f"{tmp_path}/t")
    spark.createDataFrame(_windows(5), SHAPE).coalesce(1).write.parquet(f"{tmp_path}/w")
    pairs = ranges.range_join(spark.read.parquet(f"{tmp_path}/w"), spark.read.parquet(f"{tmp_path}/t"))
    assert sorted((r.query_id, r.id) for r in pairs.collect()) == sorted((k, i) for k, own in _want(_windows(5), _rows(5, 500)).items() for i in own)
    plan = pairs._jdf.queryExecution().executedPlan().toString()  # with what was changed while it ran
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_empty_tables(spark):
    t, w = spark.createDataFrame([], "id long, duration_ms long"), spark.createDataFrame(_windows(3), SHAPE)
    assert ranges.range_join(w, t).count() == 0 and ranges.window_page(w, t).count() == 0
    assert {r.total for r in ranges.window_totals(w, t).collect()} == {0}
    some = spark.createDataFrame(_rows(3, 20), "id long, duration_ms long")
    assert ranges.range_join(w.limit(0), some).count() == 0 and ranges.window_totals(w.limit(0), some).count() == 0


def test_a_hot_time_fills_no_part(spark):
    """A third of 60,000 rows has one time: it is spread, and no key of the join holds more than twice its share."""
    t = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, 180_000).otherwise(F.pmod(F.xxhash64("id"), F.lit(900_000))).cast("long").alias("duration_ms"))
    splits = ranges.split_points(t, "duration_ms")
    sizes = [r["count"] for r in ranges.dealt(t, "duration_ms", splits).groupBy("_part").count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) < 2 * 60_000 / ranges.PARTS
    by_bucket = ranges.dealt(t, "duration_ms", splits).groupBy(F.floor(F.col("duration_ms") / 1000), "_part").count().agg(F.max("count")).first()[0]
    assert by_bucket < 2 * 60_000 / ranges.PARTS
    ordered = ranges.in_order(t)
    assert sorted(r.place for r in ordered.select("place").collect()) == list(range(60_000))
    runs = [r["count"] for r in ordered.groupBy(F.spark_partition_id()).count().collect()]
    assert len(runs) > 1


def test_no_pairs_for_totals_and_no_shuffle_for_scans(spark, tiny):
    plan = q.QUERIES["e9_range_totals"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    for name in ("a3_scan_ids", "a3_scan_all_ids"):
        assert "Exchange" not in q.QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()

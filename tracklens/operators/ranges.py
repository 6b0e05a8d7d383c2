"""Windows on one whole number, such as the times of tracks: split points, totals and pages.

``split_points`` measures quantiles once; they cut rows and windows into the same parts, so that a
window meets a row by an equi-join. A value that many rows share fills several parts, and its rows are
spread over them, so that every part holds about as many rows, whatever the values.

``window_totals`` and ``window_page`` answer windows without pairs. In the order of the value a window
is a range of places: totals come from counts by value, and only the rows of the page asked for are joined.

Defined results: rows without a value are in no window; a window without a low end begins at 0, one without
a high end ends at the greatest value; a window that ends before it begins, and an empty table, give no rows
and a total of 0; of rows with one value the order is by ``tie``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.sources.staging import written

PARTS = 128
#: Values that one row of counts stands for.
WIDTH = 1000


def split_points(rows: DataFrame, key: str, parts: int = PARTS) -> list[int]:
    """Measured quantiles, ascending; none for an empty table. The aggregate is merged before it moves."""
    at = [k / parts for k in range(1, parts)]
    return rows.agg(F.percentile_approx(key, at, F.lit(100 * parts))).first()[0] or []  # at most ``parts`` numbers


def _passed(column: str, splits: list[int], equal: bool) -> Column:
    """How many split points are below the column, or not above it: bisection by steps that are powers of two, as an expression too short to burst a method."""
    steps = [1 << k for k in reversed(range(len(splits).bit_length()))] or [1]
    points = F.array(*[F.lit(s).cast("long") for s in [*splits, *[None] * (2 * steps[0] - 1 - len(splits))]])  # no step passes one that is missing
    passes = lambda s: s <= F.col(column) if equal else s < F.col(column)
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: at + F.when(passes(points[at + step - 1]), step).otherwise(0))


def first_part(low: str, splits: list[int]) -> Column:
    """The first part that can hold values from those of the column ``low`` on."""
    return _passed(low, splits, equal=False)


def last_part(high: str, splits: list[int]) -> Column:
    """The last part that can hold values up to those of the column ``high``."""
    return _passed(high, splits, equal=True)


def dealt(rows: DataFrame, key: str, splits: list[int]) -> DataFrame:
    """Rows with their ``_part``; those of a value that fills several parts are spread by the digest of the row."""
    own = rows.filter(F.col(key).isNotNull()).withColumns({"_at": first_part(key, splits), "_to": last_part(key, splits)})
    # One digest for each row: the same whenever a lost task is run again.
    return own.withColumn("_part", (F.col("_at") + F.pmod(F.xxhash64(*rows.columns), F.col("_to") - F.col("_at") + 1)).cast("int")).drop("_at", "_to")


def range_join(queries: DataFrame, tracks: DataFrame, bucket_ms: int = 1000, widest: int = 300_000) -> DataFrame:
    """Each query's tracks with ``min_ms <= duration_ms <= max_ms``.

    Windows of at most ``widest`` are joined by bucket and part, wider ones by part alone, an open side reaching
    to the longest track. Both are equi-joins on keys that hold at most about a part of the tracks; neither side
    goes through the driver. All pairs are the result; ``window_totals`` and ``window_page`` answer without them.
    """
    splits = split_points(tracks, "duration_ms")
    least, longest = tracks.agg(F.min("duration_ms"), F.max("duration_ms")).first()
    # A window is cut to where tracks are, else its buckets without any could be more than those with some.
    low, high = F.greatest(F.coalesce("min_ms", F.lit(0)), F.lit(least)), F.least(F.coalesce("max_ms", F.lit(longest)), F.lit(longest))
    q = queries.withColumns({"_low": low, "_high": high}).filter("_low <= _high")
    rows, wide = dealt(tracks, "duration_ms", splits), F.col("_high") - F.col("_low") > widest
    parts = F.explode(F.sequence(first_part("_begin", splits), last_part("_end", splits)))
    short = q.filter(~wide).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_low") / bucket_ms), F.floor(F.col("_high") / bucket_ms))))
    begin = F.col("_bucket") * bucket_ms
    short = short.withColumns({"_begin": F.greatest("_low", begin), "_end": F.least("_high", begin + bucket_ms - 1)}).withColumn("_part", parts).drop("_begin", "_end")
    long = q.filter(wide).withColumns({"_begin": F.col("_low"), "_end": F.col("_high")}).withColumn("_part", parts).drop("_begin", "_end")
    tasks = int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def met(windows: DataFrame, tracks: DataFrame, keys: list[str]) -> DataFrame:
        """Both are dealt to all tasks by key and merged. A file of a few MB holds many rows, which the planner would take for few enough to broadcast."""
        pairs = windows.repartition(tasks, *keys).join(tracks.repartition(tasks, *keys).hint("merge"), keys)
        return pairs.filter(F.col("duration_ms").between(F.col("_low"), F.col("_high"))).drop("_bucket", "_part", "_low", "_high")

    by_bucket = met(short, rows.withColumn("_bucket", F.floor(F.col("duration_ms") / bucket_ms)), ["_bucket", "_part"])
    return by_bucket.unionByName(met(long, rows, ["_part"]))


def window_totals(queries: DataFrame, rows: DataFrame, key: str = "duration_ms", low: str = "min_ms", high: str = "max_ms") -> DataFrame:
    """Queries with ``total``, the number of rows in their window, and ``first``, the place of the first of them from 0 on.

    Rows are counted by value before they move; a bucket's counts are one row of at most ``WIDTH`` steps. Places where buckets begin are
    a running sum over one row for each ``WIDTH`` values up to the greatest: as many as the longest track has seconds, however many tracks there are.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("v")).agg(F.count("*").alias("n"))
    least, greatest = (rows.agg(f(F.col(key).cast("long"))).scalar() for f in (F.min, F.max))
    bucket = lambda x: F.floor(x / WIDTH)
    filled = counts.groupBy(bucket(F.col("v")).alias("_bucket")).agg(F.sum("n").alias("_n"), F.collect_list(F.struct("v", "n")).alias("_steps"))
    every = rows.sparkSession.range(1).select(F.explode(F.sequence(bucket(least), bucket(greatest + 1))).alias("_bucket"))
    before = F.sum(F.coalesce("_n", F.lit(0))).over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = every.join(filled.select("_bucket", "_n"), "_bucket", "left").select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    table = starts.join(filled.select("_bucket", "_steps"), "_bucket", "left")

    def placed(q: DataFrame, bound: Column, name: str) -> DataFrame:
        """How many rows have a value below ``bound``."""
        own = q.withColumn("_x", F.greatest(F.least(bound, greatest + 1), least)).withColumn("_bucket", bucket(F.col("_x")))
        smaller = F.aggregate(F.coalesce("_steps", F.array().cast("array<struct<v:bigint,n:bigint>>")), F.lit(0).cast("long"), lambda a, s: a + F.when(s["v"] < F.col("_x"), s["n"]).otherwise(0))
        return own.join(table, "_bucket", "left").withColumn(name, F.coalesce(F.col("_before") + smaller, F.lit(0).cast("long"))).drop("_bucket", "_x", "_before", "_steps")

    begun = placed(queries, F.coalesce(F.col(low), F.lit(0)).cast("long"), "first")
    ended = placed(begun, F.coalesce(F.col(high).cast("long"), greatest) + 1, "_end")
    return ended.withColumn("total", F.greatest(F.col("_end") - F.col("first"), F.lit(0))).drop("_end")


def in_order(rows: DataFrame, key: str = "duration_ms", tie: str = "id") -> DataFrame:
    """Rows with ``place``, their number from 0 on by ``key`` and ``tie``. They are laid out once, in ranges, and written."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.filter(F.col(key).isNotNull()).repartitionByRange(n, key, tie).sortWithinPartitions(key, tie)
    laid = written(laid.withColumn("_at", F.monotonically_increasing_id()), "in-order").withColumn("_run", F.shiftright("_at", 33))
    runs = laid.groupBy("_run").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select("_run", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.join(F.broadcast(starts), "_run").withColumn("place", F.col("_before") + own).drop("_run", "_at", "_before")  # one row for each of n partitions


def window_page(queries: DataFrame, rows: DataFrame, page: int | Column = 1, per_page: int | Column = 20, key: str = "duration_ms", tie: str = "id", low: str = "min_ms", high: str = "max_ms") -> DataFrame:
    """One page of each query's window by ``key`` and ``tie``, with ``total`` and the row's ``position`` in the window from 1 on.

    ``page`` and ``per_page`` may be columns of the queries. Each query is joined with the places of its page only.
    """
    spans = window_totals(queries, rows, key, low, high)
    number, size = (x if isinstance(x, Column) else F.lit(x) for x in (page, per_page))
    begin = F.col("first") + (number - 1) * size
    spans = spans.withColumns({"_from": begin.cast("long"), "_to": F.least(begin + size, F.col("first") + F.col("total")).cast("long")}).filter("_from < _to")
    asked = spans.withColumn("place", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)))
    return asked.join(in_order(rows, key, tie), "place").withColumn("position", F.col("place") - F.col("first") + 1).drop("place", "first", "_from", "_to")

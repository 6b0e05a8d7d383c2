"""Streams of requests, impressions, change packets and tags.

Every operator is a function of DataFrames that works on a stream and on a table alike, so that
tests can hold one against the other; ``run_available`` drives a stream to its end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.operators import relational as rel

LATENESS = "10 minutes"


def search_counter(requests: DataFrame) -> DataFrame:
    return requests.groupBy().agg(F.count("*").alias("total_searches"))


def search_credit(impressions: DataFrame, tracks: DataFrame) -> DataFrame:
    """Credit per track: each shown unscored track gets one part in as many as the search found."""
    open_ = tracks.filter("popularity_source IS NULL OR popularity_source = 'unfound'").select(F.col("id").alias("track_id"))
    shown = impressions.filter("mode = 'tracks'").join(open_, "track_id")
    return shown.groupBy("track_id").agg(F.sum(1.0 / F.least("raw_count", F.lit(10_001))).alias("credit"))


def priority_bump(impressions: DataFrame, tracks: DataFrame) -> DataFrame:
    """Tracks to move to priority 1: shown, and without any source yet."""
    new = tracks.filter("popularity_source IS NULL").select(F.col("id").alias("track_id"))
    return impressions.filter("mode = 'tracks'").join(new, "track_id").select("track_id").distinct()


def rate_limit_flags(requests: DataFrame, limit: int = 100, seconds: int = 60, client: str = "client") -> DataFrame:
    """Clients with more than ``limit`` requests in a minute."""
    counted = requests.withWatermark("ts", LATENESS) if requests.isStreaming else requests
    counted = counted.groupBy(F.window("ts", f"{seconds} seconds"), client).agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") > limit).select(F.col("window.start").alias("start"), client, "n")


def micro_scoring(queue: DataFrame, tracks: DataFrame, by_mbid: DataFrame, by_name: DataFrame, secondary: DataFrame, n: int = 80) -> tuple[DataFrame, DataFrame]:
    """One tick: the scores of the next batch, and the queue without it.

    ``written_back`` puts the scores into the tracks.
    """
    batch = rel.work_batch(queue, n)
    rows = rel.queue_rows(batch, tracks).select("id", "mb_id", "artist", "title")
    scores = rel.popularity_cascade(rows, by_mbid, by_name, secondary).select("id", "new_popularity", "new_source")
    return scores, rel.drain_queue(queue, batch)


def written_back(tracks: DataFrame, scores: DataFrame) -> DataFrame:
    """The tracks with the scores of a tick."""
    found = scores.select("id", F.col("new_popularity").alias("popularity"), F.col("new_source").alias("popularity_source"))
    return rel.apply_updates(tracks, found, "id", {"popularity": "overwrite", "popularity_source": "overwrite"})


def genre_fill(tracks: DataFrame, tags: DataFrame) -> DataFrame:
    """Rows without genre get the tag with most votes."""
    none = tracks.filter("genre IS NULL").drop("genre")
    return none.join(rel.top_tag(tags), "mb_id")


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs a stream over what is there and stops; offsets are kept in the checkpoint."""
    stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

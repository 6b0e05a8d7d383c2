"""Joins, aggregations, windows, paging and set operations on tracks and what belongs to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions import expr

# ---- updates and appends -------------------------------------------------------------------


def insert_ignore(new: DataFrame, existing: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """The new rows whose key is not there yet; of several with one key, the first in order."""
    w = Window.partitionBy(key).orderBy(*(order or [F.col(c).asc_nulls_first() for c in new.columns]))
    one = new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return one.join(existing.select(key), key, "left_anti").select(*new.columns)


def apply_updates(base: DataFrame, updates: DataFrame, key: str, policy: dict[str, str]) -> DataFrame:
    """Base rows with the columns of ``policy`` taken from the updates by key.

    ``overwrite`` takes null too where a key has an update; ``keep_non_null`` does not. Of several
    updates of a key the first by its values counts, nulls last, so that no base row is repeated.
    """
    values = F.struct(*[x for c in policy for x in (F.col(c).isNull().alias(f"n{c}"), F.col(c).alias(c))])
    one = updates.groupBy(key).agg(F.min(values).alias("_u"))
    renamed = one.select(key, F.lit(True).alias("_hit"), *[F.col("_u").getField(c).alias(f"_{c}") for c in policy])
    joined = base.join(renamed, key, "left")
    new = {
        c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) if how == "overwrite" else F.coalesce(F.col(f"_{c}"), F.col(c))
        for c, how in policy.items()
    }
    return joined.withColumns(new).select(*base.columns)


def delete_missing(df: DataFrame, c: str) -> DataFrame:
    return df.filter(F.col(c).isNotNull())


def ensure_columns(df: DataFrame, schema) -> DataFrame:
    """Adds the columns of a schema that are absent, as nulls; adding twice changes nothing."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name.lower() not in have})


def scan_ids(df: DataFrame, low: int, high: int, key: str = "id") -> DataFrame:
    """Keys in [low, high): only their column is read, and of sorted files only those of the range. Nothing is shuffled."""
    return df.filter((F.col(key) >= low) & (F.col(key) < high)).select(key)


def scan_all_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """All keys. The files' splits deal them, so the table's size tells how many tasks there are."""
    return df.filter(F.col(key).isNotNull()).select(key)


# ---- joins ---------------------------------------------------------------------------------


def matches_to_rows(hits: DataFrame, tracks: DataFrame) -> DataFrame:
    return hits.join(tracks, "id")


def queue_rows(queue: DataFrame, tracks: DataFrame) -> DataFrame:
    return queue.join(tracks, queue["track_id"] == tracks["id"])


def with_lookup(df: DataFrame, dim: DataFrame, on: str, key: str, value: str, as_name: str) -> DataFrame:
    """Adds one value of a dimension; the planner broadcasts it if its measured size allows."""
    named = dim.select(F.col(key).alias("_key"), F.col(value).alias(as_name))
    return df.join(named, df[on] == F.col("_key"), "left").drop("_key")


def keep_ours(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def only_new(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return df.join(existing.select(key), key, "left_anti")


def merge_features(rhythm: DataFrame, tonal: DataFrame, lowlevel: DataFrame, key: str = "mb_id") -> DataFrame:
    return rhythm.join(tonal, key, "full").join(lowlevel, key, "full")


def popularity_cascade(tracks: DataFrame, by_mbid: DataFrame, by_name: DataFrame, secondary: DataFrame) -> DataFrame:
    """Score and source: listeners by id, else by artist and title, else users by id; else unfound and 0.

    Lookup tables carry a status; a miss only counts where the service answered ``ok``. A key
    found with no listeners is found: its score is 0. Of several answers for a key the largest counts.
    """
    a = by_mbid.filter("status = 'ok'").groupBy("mb_id").agg(F.max("listeners").alias("_a"))
    b = by_name.filter("status = 'ok'").groupBy(F.lower("artist").alias("_artist"), F.lower("title").alias("_title")).agg(F.max("listeners").alias("_b"))
    c = secondary.filter("status = 'ok'").groupBy("mb_id").agg(F.max("total_user_count").alias("_c"))
    joined = tracks.join(a, "mb_id", "left").join(b, (F.lower("artist") == F.col("_artist")) & (F.lower("title") == F.col("_title")), "left").join(c, "mb_id", "left")
    first = F.coalesce("_a", "_b")
    return joined.withColumns({
        "new_popularity": F.when(first.isNotNull(), expr.log_score(first, expr.CEILING_FIRST)).when(F.col("_c") > 0, expr.log_score(F.col("_c"), expr.CEILING_SECOND)).otherwise(0),
        "new_source": F.when(first.isNotNull(), "lastfm").when(F.col("_c") > 0, "listenbrainz").otherwise("unfound"),
    }).drop("_a", "_b", "_c", "_artist", "_title")


def duration_candidates(tracks: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """A second opinion on durations: outcome ``confirmed``, ``source1``, ``source2`` or ``review``.

    First source: by artist, the first candidate in its order whose normalised title is the
    track's and whose time is positive; else the second source by artist and title.
    """
    mine = tracks.withColumns({"_a": F.lower("artist"), "_t": expr.norm_title(F.col("title"))})
    c1 = first.filter("track_time_ms > 0").groupBy(F.lower("artist").alias("_a"), expr.norm_title(F.col("track_name")).alias("_t")).agg(
        F.min_by("track_time_ms", F.struct("position", "track_time_ms")).alias("_one")
    )
    c2 = second.filter("duration_ms > 0").groupBy(F.lower("artist").alias("_a"), expr.norm_title(F.col("title")).alias("_t")).agg(F.min("duration_ms").alias("_two"))
    joined = mine.join(c1, ["_a", "_t"], "left").join(c2, ["_a", "_t"], "left")
    found = F.coalesce("_one", "_two")
    return joined.withColumns({
        "found_ms": found,
        "outcome": F.when(found.isNull(), "review").when(found == F.col("duration_ms"), "confirmed").when(F.col("_one").isNotNull(), "source1").otherwise("source2"),
    }).drop("_a", "_t", "_one", "_two")


def duration_recheck(review: DataFrame, authority: DataFrame) -> DataFrame:
    """The authority's length where it differs; null where it is the same or absent."""
    a = authority.select("mb_id", F.col("length_ms").alias("_l"))
    return review.join(a, "mb_id", "left").withColumn("new_ms", F.when(F.col("_l") != F.col("duration_ms"), F.col("_l"))).drop("_l")


def cdc_pair(pending: DataFrame, data: DataFrame) -> DataFrame:
    full = data.filter("iskey = 'f'").select("xid", expr.payload_gid(F.col("payload")).alias("gid"))
    return pending.join(full, "xid").filter("gid IS NOT NULL")


def rescue_join(unfound: DataFrame, secondary: DataFrame) -> DataFrame:
    users = secondary.filter((F.col("status") == "ok") & (F.col("total_user_count") > 0)).select("mb_id", "total_user_count")
    return unfound.join(users, "mb_id").withColumn("new_popularity", expr.log_score(F.col("total_user_count"), expr.CEILING_SECOND))


# ---- aggregations --------------------------------------------------------------------------


def status(tracks: DataFrame) -> DataFrame:
    """Rows by source, and all of them (source null), in one pass."""
    return tracks.select(F.coalesce("popularity_source", F.lit("unscored")).alias("src")).rollup("src").agg(F.count("*").alias("n"))


def capped_count(df: DataFrame, cap: int | None = 10_000) -> DataFrame:
    """Counts to one over the cap and stops; shows the cap and a flag beyond it. Without a cap the count is exact."""
    if cap is None:
        return df.agg(F.count("*").alias("total")).withColumn("capped", F.lit(False))
    n = df.limit(cap + 1).agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(cap)).alias("total"), (F.col("n") > cap).alias("capped"))


def song_count(df: DataFrame, cap: int | None = 10_000) -> DataFrame:
    return capped_count(df.select(F.lower("title").alias("t"), F.lower("artist").alias("a")).distinct(), cap)


def artist_count(df: DataFrame, cap: int | None = 10_000) -> DataFrame:
    return capped_count(df.select("artist").distinct(), cap)


def top_n_per(df: DataFrame, key: str, by: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; ranks above ``n`` are cut before rows move."""
    w = Window.partitionBy(key).orderBy(*by)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def artist_score(df: DataFrame, n: int = 20) -> DataFrame:
    """Sum of each artist's ``n`` largest popularity values."""
    top = top_n_per(df, "artist", [F.coalesce("popularity", F.lit(0)).desc(), F.col("id")], n)
    return top.groupBy("artist").agg(F.sum(F.coalesce("popularity", F.lit(0))).alias("score"))


def top_tags(df: DataFrame, entity: str = "entity", name: str = "name", count: str = "count", n: int = 5) -> DataFrame:
    """The ``n`` names with most votes, joined; equal votes by name."""
    top = top_n_per(df, entity, [F.col(count).desc(), F.col(name)], n)
    listed = top.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("rank", name))).alias("names"))
    return listed.select(entity, F.array_join(F.transform("names", lambda x: x[name]), ", ").alias("genre"))


def first_release(track: DataFrame, medium: DataFrame) -> DataFrame:
    """Each recording's lowest release, and its place on it."""
    m = medium.select(F.col("id").alias("medium"), "release")
    return track.join(m, "medium").groupBy("recording").agg(F.min("release").alias("release"), F.min_by("position", F.struct("release", "id")).alias("track_number"))


def union_dates(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("release", "year").unionByName(b.select("release", "year"))


def first_year(a: DataFrame, b: DataFrame) -> DataFrame:
    return union_dates(a, b).groupBy("release").agg(F.min("year").alias("release_year"))


def first_value(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))


def first_features(df: DataFrame, key: str, order: str) -> DataFrame:
    """Per key the first row, in order, that has any value."""
    values = [c for c in df.columns if c not in (key, order)]
    some = df.filter(F.coalesce(*[F.col(c).cast("string") for c in values]).isNotNull())
    return some.groupBy(key).agg(F.min_by(F.struct(*values), order).alias("f")).select(key, *[F.col(f"f.{c}").alias(c) for c in values])


def earliest_dated(releases: Column) -> Column:
    """Of ``array<struct<date, ...>>`` the one with the earliest date; without dates the first."""
    keyed = F.transform(releases, lambda r, i: F.struct(F.coalesce(F.nullif(r["date"], F.lit("")), F.lit("~")).alias("d"), i.alias("i"), r.alias("r")))
    return F.get(F.array_sort(keyed), F.lit(0))["r"]


def top_tag(tags: DataFrame, key: str = "mb_id") -> DataFrame:
    return tags.filter("count > 0").groupBy(key).agg(F.max_by("name", F.struct("count", -F.col("position"))).alias("genre"))


def scoring_summary(df: DataFrame, source: str = "popularity_source") -> DataFrame:
    hit = F.col(source).isin("lastfm", "listenbrainz")
    return df.agg(
        *[F.count_if(F.col(source) == s).alias(s) for s in ("lastfm", "listenbrainz", "unfound")],
        F.round(F.avg(F.when(hit, 100.0).otherwise(0.0)), 1).alias("hit_percent"),
    )


def dry_run_summary(df: DataFrame, existing: DataFrame, key: str = "mb_id") -> DataFrame:
    marked = df.join(existing.select(key, F.lit(1).alias("_old")).distinct(), key, "left")
    fresh = F.count_if(F.col("_old").isNull())
    return marked.agg(F.count("*").alias("scanned"), fresh.alias("new"), (3 * fresh).alias("writes"), (3 * fresh / 1e6).alias("cost"))


def import_summary(df: DataFrame) -> DataFrame:
    ok = (F.coalesce(F.col("title"), F.lit("")) != "") & F.col("mb_id").isNotNull() & (F.col("duration_ms") > 0)
    return df.agg(F.count_if(ok & F.col("isrc").isNotNull()).alias("imported"), F.count_if(F.col("isrc").isNull()).alias("no_isrc"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("invalid"))


def songs_per_year(df: DataFrame) -> DataFrame:
    return df.groupBy("year").agg(F.count("*").alias("songs"), F.min("bowl").alias("label")).orderBy(F.col("year").desc())


def max_id(df: DataFrame, key: str = "id") -> DataFrame:
    return df.agg(F.max(key).alias("max_id"))


def outcome_counts(df: DataFrame, c: str = "outcome") -> DataFrame:
    return df.groupBy(c).agg(F.count("*").alias("n"))


# ---- version groups, order, pages ----------------------------------------------------------


def song_keys() -> list[Column]:
    return [F.lower("title"), F.lower("artist")]


def headline_order() -> list[Column]:
    return [expr.headline_score(F.col("popularity"), F.col("version")).desc(), F.col("duration_ms").asc_nulls_last(), F.col("id")]


def headline(df: DataFrame) -> DataFrame:
    """One row per song, its best version, with ``version_count``.

    Best row and count are one aggregate, merged within partitions before rows move, so that a song, or what has no title,
    may hold any part of the table.
    """
    names = df.columns
    better = F.struct(expr.headline_score(F.col("popularity"), F.col("version")).alias("s"), (-F.coalesce("duration_ms", F.lit(2**62))).alias("d"), (-F.col("id")).alias("i"))
    best = df.groupBy(*song_keys()).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in names]), better).alias("_best"), F.count("*").alias("version_count"))
    return best.select(*[F.col(f"_best.`{c}`").alias(c) for c in names], "version_count")


def relevance_order(second: str = "duration_ms") -> list[Column]:
    return [expr.rank_score(F.col("popularity"), F.col("search_count")).desc_nulls_last(), F.col(second).asc_nulls_last(), F.col("id")]


def duration_order(direction: str) -> list[Column]:
    c = F.col("duration_ms")
    return [c.asc_nulls_first() if direction == "asc" else c.desc_nulls_last(), F.col("id")]


def artist_order(sort: str) -> list[Column]:
    return [F.lower("artist"), F.col("artist")] if sort == "asc" else [F.lower("artist").desc(), F.col("artist").desc()] if sort == "desc" else [F.col("score").desc(), F.col("artist")]


def page(df: DataFrame, order: list[Column], number: int, per_page: int) -> DataFrame:
    """One page with ``position`` in the whole order and ``has_more``; one row more than a page is read."""
    rows = df.orderBy(*order).offset((number - 1) * per_page).limit(per_page + 1)
    w = Window.orderBy(*order)  # over at most a page and one row
    numbered = rows.withColumns({"_i": F.row_number().over(w), "has_more": F.count("*").over(Window.partitionBy()) > per_page})
    return numbered.filter(F.col("_i") <= per_page).withColumn("position", F.col("_i") + (number - 1) * per_page).drop("_i")


def candidate_cap(df: DataFrame, n: int = 4000) -> DataFrame:
    """The first ``n`` rows in relevance order, among which songs are then grouped."""
    return df.orderBy(*relevance_order()).limit(n)


def versions_cap(df: DataFrame, n: int = 500) -> DataFrame:
    """The first ``n`` rows of one song in headline order."""
    return df.orderBy(*headline_order()).limit(n)


def total_pages(total: Column, number: Column, per_page: Column) -> dict[str, Column]:
    return {
        "pages": F.least(F.lit(500), F.ceil(total / per_page)).cast("long"),
        "shown_from": (number - 1) * per_page + 1,
        "shown_to": F.least(total, number * per_page),
    }


def work_batch(queue: DataFrame, n: int = 80, fill: bool = False) -> DataFrame:
    """``n`` rows of the highest waiting priority only; with ``fill``, lower ones after them."""
    order = [F.col("priority").desc(), F.col("track_id")]
    if fill:
        return queue.orderBy(*order).limit(n)
    return queue.filter(F.col("priority") == queue.agg(F.max("priority")).scalar()).orderBy(*order).limit(n)


def cursor_batch(df: DataFrame, after: int, n: int, key: str = "id") -> DataFrame:
    return df.filter(F.col(key) > after).orderBy(key).limit(n)


# ---- the work queue ------------------------------------------------------------------------


def bootstrap_queue(tracks: DataFrame, queue: DataFrame) -> DataFrame:
    """The queue and all unscored tracks that are not in it, at priority 0."""
    new = tracks.filter("popularity IS NULL").select(F.col("id").alias("track_id"), F.lit(0).alias("priority"))
    return queue.select("track_id", "priority").unionByName(new.join(queue.select("track_id"), "track_id", "left_anti"))


def refill_queue(tracks: DataFrame, queue: DataFrame) -> DataFrame:
    return tracks.filter("popularity IS NULL").select(F.col("id").alias("track_id")).join(queue.select("track_id"), "track_id", "left_anti")


def drain_queue(queue: DataFrame, done: DataFrame) -> DataFrame:
    return queue.join(done.select("track_id"), "track_id", "left_anti")

"""Jobs that load the catalogue and enrich it from dump tables, feature files and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.functions import expr
from tracklens.operators import filters, relational as rel
from tracklens.schemas import TRACKS
from tracklens.sources import dumps


def _recordings(dump: dict[str, DataFrame]) -> DataFrame:
    """Recordings with credit and first ISRC, in track columns."""
    isrc = rel.first_value(dump["isrc"].select("id", "recording", "isrc"), "recording", "isrc", "id").withColumnRenamed("recording", "_r")
    rows = rel.with_lookup(dump["recording"], dump["artist_credit"], "artist_credit", "id", "name", "artist")
    rows = rows.join(isrc, F.col("id") == F.col("_r"), "left").drop("_r")
    return rows.select(
        "id", F.col("gid").alias("mb_id"), F.col("name").alias("title"), "artist", F.col("length").alias("duration_ms"), F.col("comment").alias("version"), "isrc"
    )


def import_catalogue(dump: dict[str, DataFrame], existing: DataFrame) -> DataFrame:
    """New importable recordings as full track rows; one per id, the smallest row key."""
    new = filters.importable(_recordings(dump))
    return rel.ensure_columns(rel.insert_ignore(new, existing, "mb_id", [F.col("id")]), TRACKS).select(*TRACKS.fieldNames())


def import_delta(dump: dict[str, DataFrame], existing: DataFrame, dry_run: bool = False) -> DataFrame:
    """The same for a later dump; dry, only what it would cost."""
    found = filters.importable(_recordings(dump))
    return rel.dry_run_summary(found, existing) if dry_run else import_catalogue(dump, existing)


def release_chain(dump: dict[str, DataFrame], ours: DataFrame) -> DataFrame:
    """Per recording of ours its first release with album, type, label, year, place and language."""
    track = rel.keep_ours(dump["track"], ours.select(F.col("id").alias("recording")), "recording")
    first = rel.first_release(track, dump["medium"])
    release = dump["release"].select(F.col("id").alias("release"), F.col("name").alias("album"), "release_group", "language")
    kinds = dump["release_group"].join(dump["release_group_primary_type"].select(F.col("id").alias("type"), F.col("name").alias("release_type")), "type", "left")
    labels = dump["release_label"].join(dump["label"].select(F.col("id").alias("label"), F.col("name").alias("label_name")), "label").filter("label_name IS NOT NULL")
    labels = labels.groupBy("release").agg(F.min_by("label_name", "id").alias("label"))
    years = rel.first_year(dump["release_country"], dump["release_unknown_country"])
    out = first.join(release, "release", "left").join(kinds.select(F.col("id").alias("release_group"), "release_type"), "release_group", "left")
    out = out.join(labels, "release", "left").join(years, "release", "left")
    return out.withColumn("release_type", F.when(F.col("release_group").isNotNull(), F.coalesce("release_type", F.lit("Other"))))


def enrich_release(tracks: DataFrame, dump: dict[str, DataFrame]) -> DataFrame:
    found = release_chain(dump, tracks).select(F.col("recording").alias("id"), "album", "release_year", "release_type", "label", F.col("track_number").cast("int").alias("track_number"))
    return rel.apply_updates(tracks, found, "id", dict.fromkeys(("album", "release_year", "release_type", "label", "track_number"), "overwrite"))


def genre_level(votes: DataFrame, tags: DataFrame, curated: DataFrame | None) -> DataFrame:
    named = votes.join(tags.select(F.col("id").alias("tag"), "name"), "tag")
    return rel.top_tags(filters.genre_votes(named, curated))


def enrich_genre(tracks: DataFrame, dump: dict[str, DataFrame]) -> DataFrame:
    """Genres voted for the recording; else for its release group; else for its first artist."""
    tags, curated = dump["tag"], dump.get("genre")
    by_recording = genre_level(dump["recording_tag"], tags, curated).select(F.col("entity").alias("id"), F.col("genre").alias("g1"))
    groups = release_chain(dump, tracks).select(F.col("recording").alias("id"), F.col("release_group").alias("entity"))
    by_group = groups.join(genre_level(dump["release_group_tag"], tags, curated), "entity").select("id", F.col("genre").alias("g2"))
    artists = first_artists(dump).select(F.col("recording").alias("id"), F.col("artist").alias("entity"))
    by_artist = artists.join(genre_level(dump["artist_tag"], tags, curated), "entity").select("id", F.col("genre").alias("g3"))
    found = tracks.select("id").join(by_recording, "id", "left").join(by_group, "id", "left").join(by_artist, "id", "left")
    return rel.apply_updates(tracks, found.select("id", F.coalesce("g1", "g2", "g3").alias("genre")), "id", {"genre": "keep_non_null"})


def first_artists(dump: dict[str, DataFrame]) -> DataFrame:
    first = rel.first_value(dump["artist_credit_name"], "artist_credit", "artist", "position")
    return dump["recording"].select(F.col("id").alias("recording"), "artist_credit").join(first, "artist_credit")


def enrich_artist(tracks: DataFrame, dump: dict[str, DataFrame]) -> DataFrame:
    """Type, gender and country of the first artist, language of the first release; rows with none stay."""
    artist = dump["artist"].select(F.col("id").alias("artist"), "type", "area", "gender")
    who = first_artists(dump).join(artist, "artist")
    who = rel.with_lookup(who, dump["area"], "area", "id", "name", "artist_country").select(
        F.col("recording").alias("id"), expr.decode(F.col("type"), expr.ARTIST_TYPES).alias("artist_type"), expr.decode(F.col("gender"), expr.GENDERS).alias("artist_gender"), "artist_country"
    )
    spoken = release_chain(dump, tracks).select(F.col("recording").alias("id"), F.col("language").alias("lang"))
    spoken = spoken.join(dump["language"].select(F.col("id").alias("lang"), F.col("name").alias("language"), F.col("iso_code_3").alias("language_code")), "lang", "left").drop("lang")
    names = ("artist_type", "artist_gender", "artist_country", "language", "language_code")
    found = who.join(spoken, "id", "full").filter(F.coalesce(*names).isNotNull())
    return rel.apply_updates(tracks, found, "id", dict.fromkeys(names, "keep_non_null"))


def enrich_audio(tracks: DataFrame, rhythm: DataFrame, tonal: DataFrame, lowlevel: DataFrame) -> DataFrame:
    """Audio features by recording; per file the first row of an id with any value counts."""
    ours = tracks.select("mb_id")
    first = [rel.first_features(rel.keep_ours(f, ours, "mb_id"), "mb_id", "row") for f in (rhythm, tonal, lowlevel)]
    merged = rel.merge_features(*first)
    return rel.apply_updates(tracks, merged, "mb_id", {c: "keep_non_null" for c in merged.columns if c != "mb_id"})


def score_popularity(tracks: DataFrame, by_mbid: DataFrame, by_name: DataFrame, secondary: DataFrame, after: int | None = None, batch: int | None = None) -> DataFrame:
    """Track rows with new scores for the unscored ones; a cursor and batch size make it resumable."""
    waiting = filters.unscored(tracks)
    if after is not None and batch is not None:
        waiting = rel.cursor_batch(waiting, after, batch)
    found = rel.popularity_cascade(waiting.select("id", "mb_id", "artist", "title"), by_mbid, by_name, secondary)
    found = found.select("id", F.col("new_popularity").alias("popularity"), F.col("new_source").alias("popularity_source"))
    return rel.apply_updates(tracks, found, "id", {"popularity": "keep_non_null", "popularity_source": "keep_non_null"})


def score_queue(tracks: DataFrame, queue: DataFrame, by_mbid: DataFrame, by_name: DataFrame, secondary: DataFrame, after: int | None = None, batch: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tracks with scores for the waiting ones (or the next batch), the queue without those, and the summary of the new scores."""
    scored = score_popularity(tracks, by_mbid, by_name, secondary, after, batch)
    done = filters.unscored(tracks).select("id")
    if after is not None and batch is not None:
        done = rel.cursor_batch(done, after, batch)
    new = done.join(scored.select("id", "popularity_source"), "id")
    return scored, rel.drain_queue(queue, done.withColumnRenamed("id", "track_id")), rel.scoring_summary(new)


def rescue_unfound(tracks: DataFrame, secondary: DataFrame, dry_run: bool = False) -> DataFrame:
    waiting = tracks.filter("popularity_source = 'unfound'")
    found = rel.rescue_join(waiting.select("id", "mb_id"), secondary)
    if dry_run:
        both = waiting.agg(F.count("*").alias("scanned")).withColumn("hits", found.agg(F.count("*")).scalar())
        return both.withColumn("coverage_percent", F.round(100.0 * F.col("hits") / F.greatest("scanned", F.lit(1)), 1))
    found = found.select("id", F.col("new_popularity").alias("popularity"), F.lit("listenbrainz").alias("popularity_source"))
    return rel.apply_updates(tracks, found, "id", {"popularity": "keep_non_null", "popularity_source": "keep_non_null"})


def fix_durations(tracks: DataFrame, first: DataFrame, second: DataFrame, authority: DataFrame, limit: int = 3_600_000, review: str | None = None) -> DataFrame:
    """Both passes over suspicious durations: ``id, duration_ms, outcome, new_ms``.

    What the sources do not settle is held against the authority: another length is taken, the
    same or none makes the duration unknown. With a path, those rows are also written there as a review file.
    """
    suspects = filters.suspicious_duration(tracks, limit).select("id", "mb_id", "title", "artist", "duration_ms")
    judged = rel.duration_candidates(suspects, first, second)
    if review is not None:
        dumps.write_review(judged.filter("outcome = 'review'").select("id", "mb_id", "title", "artist", "duration_ms"), review)
    settled = judged.filter("outcome != 'review'").select("id", "duration_ms", "outcome", F.col("found_ms").alias("new_ms"))
    again = rel.duration_recheck(judged.filter("outcome = 'review'").select("id", "mb_id", "duration_ms"), authority)
    again = again.select("id", "duration_ms", F.when(F.col("new_ms").isNotNull(), "updated").otherwise("nulled").alias("outcome"), "new_ms")
    return settled.unionByName(again)

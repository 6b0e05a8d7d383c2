"""Schemas: the wide track table, the dump tables, and the track view of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

#: The wide table: one row per recording.
TRACKS = T.StructType([
    T.StructField(name, kind)
    for name, kind in [
        ("id", _L), ("title", _S), ("artist", _S), ("album", _S), ("duration_ms", _L), ("version", _S), ("isrc", _S),
        ("release_year", _I), ("mb_id", _S), ("genre", _S), ("popularity", _I), ("popularity_source", _S), ("search_count", _D),
        ("release_type", _S), ("label", _S), ("track_number", _I), ("artist_type", _S), ("artist_gender", _S),
        ("artist_country", _S), ("language", _S), ("language_code", _S), ("bpm", _D), ("danceability", _D),
        ("tuning_freq", _D), ("loudness", _D), ("dynamic_complexity", _D), ("key_key", _S), ("key_scale", _S),
    ]
])

#: The dump's files have no header, so positions are the schema. Unread columns are ``_``.
DUMP_COLUMNS: dict[str, str] = {
    "recording": "id gid name artist_credit length comment",
    "artist_credit": "id name",
    "artist_credit_name": "artist_credit position artist",
    "isrc": "id recording isrc",
    "genre": "id gid name",
    "tag": "id name",
    "recording_tag": "entity tag count",
    "release_group_tag": "entity tag count",
    "artist_tag": "entity tag count",
    "medium": "id release",
    "track": "id gid recording medium position",
    "release": "id gid name artist_credit release_group status _ language",
    "release_country": "release country year",
    "release_unknown_country": "release year",
    "release_label": "id release label",
    "label": "id gid name",
    "release_group": "id gid name artist_credit type",
    "release_group_primary_type": "id name",
    "language": "id iso_code_3 _ _ _ _ name",
    "area": "id gid name",
    "artist": "id gid name _ _ _ _ _ _ _ type area gender",
    "dbmirror_pending": "seq table_name op xid",
    "dbmirror_pendingdata": "xid iskey payload",
}
#: Columns read as whole numbers, by their leading digits.
DUMP_NUMBERS = frozenset(
    "id artist_credit length position artist recording entity tag count release medium release_group status language country year label type area gender seq xid".split()
)
#: Columns without which a line is short and left out: the last that is read.
DUMP_LAST = {t: [c for c in cols.split() if c != "_"][-1] for t, cols in DUMP_COLUMNS.items()}

#: The track view of ``part``; the same expressions run in Spark and in the checking engine.
TRACK_VIEW: dict[str, str] = {
    "id": "p_partkey",
    "title": "p_name",
    "artist": "p_brand",
    "album": "p_type",
    "duration_ms": "CAST(round(p_retailprice * 200) AS BIGINT)",
    "version": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'live' END",
    "isrc": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 'ISRC' || CAST(p_partkey AS STRING) END",
    "release_year": "CAST(CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 1960 + p_partkey % 66 END AS INT)",
    "mb_id": "'mb-' || CAST(p_partkey AS STRING)",
    "genre": "CASE p_partkey % 4 WHEN 0 THEN 'rock, hard rock' WHEN 1 THEN 'pop' WHEN 2 THEN 'jazz, soul' ELSE NULL END",
    "popularity": "CAST(CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 101 END AS INT)",
    "popularity_source": "CASE WHEN p_partkey % 10 = 0 THEN 'unfound' WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'listenbrainz' ELSE 'lastfm' END",
    "search_count": "CAST(CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 40 END AS DOUBLE) / 10",
    "release_type": "CASE p_partkey % 3 WHEN 0 THEN 'Album' WHEN 1 THEN 'Single' ELSE 'Other' END",
    "label": "CASE WHEN p_partkey % 17 = 0 THEN '[no label]' ELSE 'Label ' || CAST(p_partkey % 17 AS STRING) END",
    "artist_type": "CASE WHEN p_size % 2 = 0 THEN 'Group' ELSE 'Person' END",
    "artist_gender": "CASE p_size % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE NULL END",
    "artist_country": "CASE p_size % 4 WHEN 0 THEN 'Germany' WHEN 1 THEN 'France' WHEN 2 THEN 'Spain' ELSE NULL END",
    "language": "CASE p_size % 3 WHEN 0 THEN 'German' WHEN 1 THEN 'French' ELSE 'English' END",
    "bpm": "CAST(p_size AS DOUBLE) * 3 + CAST(p_partkey % 4 AS DOUBLE) / 4",
    "danceability": "CAST(p_partkey % 31 AS DOUBLE) / 10",
    "tuning_freq": "440 + CAST(p_partkey % 9 AS DOUBLE) / 2",
    "loudness": "0 - CAST(p_partkey % 211 AS DOUBLE) / 16",
}
TRACK_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in TRACK_VIEW.items()) + " FROM part"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The track view of the given tables; columns that a query does not use are never computed."""
    return read(spark, sf_dir, "part").selectExpr(*[f"{e} AS {n}" for n, e in TRACK_VIEW.items()])

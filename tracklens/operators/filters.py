"""Predicates of a search, stacked with AND."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.functions import expr


@dataclass(frozen=True)
class SearchSpec:
    """What one search asks for. Text values may have stars at their ends."""

    keywords: str | None = None
    wildcard: str | None = None
    min_ms: int | None = None
    max_ms: int | None = None
    tolerance_ms: int = 0
    title: str | None = None
    artist: str | None = None
    genre: str | None = None
    label: str | None = None
    country: str | None = None
    language: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    bpm_min: float | None = None
    bpm_max: float | None = None
    release_type: str | None = None
    artist_type: str | None = None
    artist_gender: str | None = None
    title_len_min: int | None = None
    title_len_max: int | None = None
    artist_len_min: int | None = None
    artist_len_max: int | None = None
    title_starts: str | None = None
    artist_starts: str | None = None
    #: Each word begins a word of the column, through the index.
    title_words: str | None = None
    artist_words: str | None = None
    mode: str = "tracks"
    sort: str = "relevance"
    group: bool = False
    page: int = 1
    per_page: int = 50


#: Parts of a credit that name a collaboration.
COLLABORATION = ["% feat%", "% ft. %", "% ft %", "% vs %", "% presents %", "% pres. %", "%;%"]
YES = F.lit


def _between(c: Column, low: float | None, high: float | None) -> Column | None:
    """Inclusive on both sides; null never matches."""
    if low is not None and high is not None:
        return c.between(low, high)
    return c >= low if low is not None else c <= high if high is not None else None


def _text(c: Column, value: str | None) -> Column | None:
    return None if not value or expr.stars_only(value) else expr.contains_value(c, value)


def duration(spec: SearchSpec, c: Column) -> Column | None:
    """The range, widened on both sides by the tolerance."""
    low = None if spec.min_ms is None else spec.min_ms - spec.tolerance_ms
    high = None if spec.max_ms is None else spec.max_ms + spec.tolerance_ms
    return _between(c, low, high)


def language(c: Column, value: str) -> Column:
    escaped = value
    for x in "\\%_":
        escaped = escaped.replace(x, "\\" + x)
    return F.ilike(c, F.lit(f"%{escaped}%"))


def starts_with(c: Column, value: str) -> Column:
    return F.lower(c).startswith(value.replace("*", "").lower())


def wildcard(spec: SearchSpec, df: DataFrame) -> Column | None:
    if not spec.wildcard or expr.stars_only(spec.wildcard):
        return None
    artist = expr.contains_value(df["artist"], spec.wildcard)
    return artist if spec.mode == "artists" else expr.contains_value(df["title"], spec.wildcard) | artist


def not_collaboration(c: Column) -> Column:
    found = F.lit(False)
    for p in COLLABORATION:
        found = found | F.ilike(c, F.lit(p))
    return c.isNotNull() & ~found


def clauses(spec: SearchSpec, df: DataFrame) -> list[Column]:
    """All predicates that the search asks for."""
    e = lambda c, v: None if v is None else df[c] == v
    found = [
        duration(spec, df["duration_ms"]),
        _text(df["title"], spec.title),
        _text(df["artist"], spec.artist),
        _text(df["genre"], spec.genre),
        _between(df["release_year"], spec.year_from, spec.year_to),
        e("release_type", spec.release_type),
        _text(df["label"], spec.label),
        e("artist_type", spec.artist_type),
        e("artist_gender", spec.artist_gender),
        _text(df["artist_country"], spec.country),
        language(df["language"], spec.language) if spec.language else None,
        _between(df["bpm"], spec.bpm_min, spec.bpm_max),
        _between(F.length(df["title"]), spec.title_len_min, spec.title_len_max),
        _between(F.length(df["artist"]), spec.artist_len_min, spec.artist_len_max),
        starts_with(df["title"], spec.title_starts) if spec.title_starts else None,
        starts_with(df["artist"], spec.artist_starts) if spec.artist_starts else None,
        wildcard(spec, df),
    ]
    return [c for c in found if c is not None]


def nothing_asked(spec: SearchSpec) -> bool:
    plain = SearchSpec()
    shape = {"mode", "sort", "group", "page", "per_page", "tolerance_ms"}
    return all(getattr(spec, f.name) == getattr(plain, f.name) for f in fields(spec) if f.name not in shape)


def apply(df: DataFrame, spec: SearchSpec) -> DataFrame:
    """The rows that meet every predicate; a search that asks for nothing finds nothing."""
    if nothing_asked(spec):
        return df.filter(F.lit(False))
    for c in clauses(spec, df):
        df = df.filter(c)
    return df


def importable(df: DataFrame) -> DataFrame:
    return df.filter(
        (F.coalesce(F.col("title"), F.lit("")) != "") & F.col("mb_id").isNotNull() & (F.col("duration_ms") > 0) & F.col("isrc").isNotNull()
    )


def suspicious_duration(df: DataFrame, limit: int = 3_600_000) -> DataFrame:
    return df.filter(F.col("duration_ms") > limit)


def unscored(df: DataFrame, include_unfound: bool = False) -> DataFrame:
    none = F.col("popularity").isNull()
    return df.filter(none | (F.col("popularity_source") == "unfound") if include_unfound else none)


def genre_votes(votes: DataFrame, curated: DataFrame | None, name: str = "name", count: str = "count", least: int = 1) -> DataFrame:
    """Votes of at least ``least`` for a curated name; no list means no restriction."""
    kept = votes.withColumn(name, F.lower(name)).filter(F.col(count) >= least)
    return kept if curated is None else kept.join(curated.select(F.lower(name).alias(name)).distinct(), name, "left_semi")


def curated_contains(df: DataFrame, text: str) -> DataFrame:
    return df.filter(F.lower(F.concat_ws(" ", "performer", "song")).contains(text.strip().lower()))


def non_empty_name(df: DataFrame, c: str = "artist") -> DataFrame:
    return df.filter(F.coalesce(F.col(c), F.lit("")) != "")


def insert_changes(df: DataFrame, table: str, op: str = "i") -> DataFrame:
    """Changes of one table and operation; the log may quote and qualify the name."""
    name = F.regexp_replace(F.trim("table_name"), '"', "")
    return df.filter((F.substring_index(name, ".", -1) == table) & (F.trim("op") == op))

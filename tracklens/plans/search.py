"""Searches as one plan each, and whole tables of searches in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions import expr
from tracklens.functions.search_log import normalize_search_log
from tracklens.operators import filters, ranges, relational as rel, text
from tracklens.operators.filters import SearchSpec
from tracklens.operators.word_index import StoredIndex
from tracklens.sources import dumps
from tracklens.sources.staging import written

COLUMNS = ["title", "artist", "album"]


def _asked_of(spec: SearchSpec) -> tuple[list[str], dict[str, list[str]]]:
    """The stems of the keywords, and those that words of a column begin with."""
    prefixes = {c: text.query_terms(expr_words(v)) for c, v in (("title", spec.title_words), ("artist", spec.artist_words)) if v}
    return text.query_terms(spec.keywords or ""), {c: p for c, p in prefixes.items() if p}


def expr_words(value: str) -> str:
    """The letters and digits of a typed value, for looking its words up."""
    return "".join(x if x.isalnum() else " " for x in value)


def _postings(tracks: DataFrame, spec: SearchSpec, index: StoredIndex | None) -> DataFrame | None:
    """The postings that a search needs: those of its words and prefixes from a stored index, or else all."""
    terms, prefixes = _asked_of(spec)
    if not terms and not prefixes:
        return None
    if index is None:
        return text.build_postings(tracks, "id", COLUMNS, stem=True)
    return index.postings(terms, [p for ps in prefixes.values() for p in ps])


def _matched(tracks: DataFrame, spec: SearchSpec, postings: DataFrame | None) -> DataFrame:
    """Tracks that meet the words and the predicates; words go through the index of stems."""
    if filters.nothing_asked(spec):
        return tracks.filter(F.lit(False))
    df = tracks
    for c in filters.clauses(spec, tracks):
        df = df.filter(c)
    terms, prefixes = _asked_of(spec)
    if terms:
        df = df.join(text.match_all(postings, terms).withColumnRenamed("doc_id", "id"), "id", "left_semi")
    for c, p in prefixes.items():
        df = df.join(text.match_column(postings, c, p).withColumnRenamed("doc_id", "id"), "id", "left_semi")
    return df


def search_tracks(tracks: DataFrame, spec: SearchSpec, index: StoredIndex | None = None) -> DataFrame:
    """One page of tracks, or of songs with ``version_count`` if grouped, in the order asked for.

    With a stored index only the ranges of the words asked for are read; without, it is built in the plan.
    """
    postings = _postings(tracks, spec, index)
    df = _matched(tracks, spec, postings)
    if spec.group:
        df = rel.headline(df)
    order = rel.relevance_order() if spec.sort == "relevance" else rel.duration_order(spec.sort)
    if spec.keywords and spec.sort == "relevance":
        lengths = index.lengths() if index else text.doc_stats(postings)
        scored = text.bm25(postings, lengths, text.query_terms(spec.keywords), text.WEIGHTS)
        df = df.join(scored.withColumnRenamed("doc_id", "id"), "id").withColumn("bm25", F.round("bm25", 9))
        order = rel.relevance_order("bm25")
    return rel.page(df, order, spec.page, spec.per_page)


#: Totals are counted so far.
TOTAL_CAP = 10_000


def search_totals(tracks: DataFrame, spec: SearchSpec, index: StoredIndex | None = None, cap: int | None = TOTAL_CAP) -> DataFrame:
    """How many tracks, or songs if grouped, a search finds: up to the cap, or without one exactly."""
    df = _matched(tracks, spec, _postings(tracks, spec, index))
    return rel.song_count(df, cap) if spec.group else rel.capped_count(df, cap)


def answer(tracks: DataFrame, spec: SearchSpec, index: StoredIndex | None = None, cap: int | None = TOTAL_CAP) -> DataFrame:
    """A search as one answer: the envelope of its page and totals, and the first word that only stems matched."""
    page = search_tracks(tracks, spec, index)
    body = dumps.result_envelope(page, search_totals(tracks, spec, index, cap), spec.page, spec.per_page)
    if not spec.keywords:
        return body.withColumn("stemmed_word", F.lit(None).cast("string"))
    asked = F.array(*[F.lit(w) for w in spec.keywords.lower().split()])
    hint = page.agg(F.first(asked).alias("asked"), F.collect_list(expr.fold_accents(F.lower(F.concat_ws(" ", *COLUMNS)))).alias("held"))  # a page: 200 rows at most
    missed = F.filter("asked", lambda w: (F.length(w) >= 3) & F.exists("held", lambda h: ~h.contains(expr.fold_accents(w))))
    return body.withColumn("stemmed_word", hint.select(F.get(missed, F.lit(0)).alias("w")).scalar())


def artist_totals(tracks: DataFrame, spec: SearchSpec) -> DataFrame:
    """The number of artists, without collaborations, that a search for artists finds."""
    df = tracks
    for c in filters.clauses(spec, tracks):
        df = df.filter(c)
    return rel.artist_count(filters.non_empty_name(df.filter(filters.not_collaboration(F.col("artist")))))


def search_artists(tracks: DataFrame, spec: SearchSpec, postings: DataFrame | None = None, phrase: str | None = None) -> DataFrame:
    """One page of artists without collaborations, by name or by the sum of their best tracks."""
    df = tracks
    for c in filters.clauses(spec, tracks):
        df = df.filter(c)
    if phrase:
        postings = text.build_postings(tracks, "id", ["artist"], stem=True) if postings is None else postings
        hits = text.match_phrase(postings, "artist", text.query_terms(phrase))
        df = df.join(hits.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    scores = rel.artist_score(df.filter(filters.not_collaboration(F.col("artist"))))
    return rel.page(filters.non_empty_name(scores), rel.artist_order(spec.sort), spec.page, spec.per_page)


def versions(tracks: DataFrame, title: str, artist: str, limit: int | None = 500) -> DataFrame:
    return text.match_song(tracks, title, artist, limit)


def curated_search(curated: DataFrame, text_: str) -> DataFrame:
    return rel.songs_per_year(filters.curated_contains(curated, text_))


#: Filters that a search of a batch may bring as columns of these names: how, and of which column of the tracks. A null asks for nothing.
BATCH_FILTERS: dict[str, tuple[str, str]] = {
    "title": ("text", "title"), "artist": ("text", "artist"), "genre": ("text", "genre"), "label": ("text", "label"), "country": ("text", "artist_country"), "language": ("part", "language"),
    "year_from": ("from", "release_year"), "year_to": ("to", "release_year"), "bpm_min": ("from", "bpm"), "bpm_max": ("to", "bpm"),
    "release_type": ("is", "release_type"), "artist_type": ("is", "artist_type"), "artist_gender": ("is", "artist_gender"),
    "title_len_min": ("long", "title"), "title_len_max": ("short", "title"), "artist_len_min": ("long", "artist"), "artist_len_max": ("short", "artist"),
    "title_starts": ("starts", "title"), "artist_starts": ("starts", "artist"),
}
#: What a hit carries until the best are known: what ranks it.
_RANKED_BY = ("duration_ms", "popularity", "search_count")


def _typed(value: Column) -> Column:
    """A typed value as ``core`` in lower case and whether stars begin or end it, as ``expr.like_pattern`` reads it; null if it asks for nothing."""
    core = F.lower(F.regexp_replace(value, r"^\*+|\*+\z", ""))
    return F.when(~value.rlike(r"^\**$"), F.struct(core.alias("core"), F.startswith(value, F.lit("*")).alias("before"), F.endswith(value, F.lit("*")).alias("after")))


def _holds(c: Column, typed: Column) -> Column:
    """The same as a LIKE of the value's pattern, without making a pattern for every pair of a search and a track."""
    low, core, longer = F.lower(c), typed["core"], F.length(F.lower(c)) > F.length(typed["core"])
    return (
        F.when(typed["before"] & typed["after"], F.contains(F.substring(low, F.lit(2), F.length(low) - 2), core))
        .when(typed["before"], F.endswith(low, core) & longer)
        .when(typed["after"], F.startswith(low, core) & longer)
        .otherwise(F.contains(low, core))
    )


def _asked_for(kind: str, value: Column) -> Column:
    """What a filter is compared with, prepared once for each search; null asks for nothing."""
    if kind == "text":
        return _typed(value)
    if kind in ("part", "starts"):
        return F.when(~value.rlike(r"^\**$"), F.lower(value if kind == "part" else F.regexp_replace(value, r"\*", "")))
    return value


def _meets(kind: str, asked: Column, c: Column) -> Column:
    """Whether a track meets one prepared filter of a search; a track without the value does not."""
    test = {
        "text": lambda: _holds(c, asked), "part": lambda: F.contains(F.lower(c), asked), "starts": lambda: F.startswith(F.lower(c), asked),
        "from": lambda: c >= asked, "to": lambda: c <= asked, "is": lambda: c == asked,
        "long": lambda: F.length(c) >= asked, "short": lambda: F.length(c) <= asked,
    }[kind]()
    return asked.isNull() | F.coalesce(test, F.lit(False))


def batch_search(queries: DataFrame, tracks: DataFrame, per_query: int = 10, index: StoredIndex | None = None) -> DataFrame:
    """A table ``(query_id, query)`` of typed searches answered in one job.

    The table may have the columns of ``BATCH_FILTERS``, ``tolerance_ms``, ``sort`` (relevance, asc, desc), ``page`` and ``per_page``
    (default ``per_query``); a null is the default. A search that asks for nothing finds nothing.

    Searches that ask for the same, whatever their page, are answered once, as far as the last of their pages goes; each asker then gets its page.

    Words are stems, as in the index: each stands for the words of the catalogue with its stem. A search meets the tracks that hold its rarest
    stem, and those hold their other stems beside them, so that nothing is grouped; searches without words take their rows from their windows, joined by bucket,
    and those with neither from the whole catalogue, unless they are a wildcard alone, which is looked up in the distinct titles and artists by its rarest run of three characters.
    What the searches may look at is written once, narrow, so wildcards and filters are tested where a search meets a track; the best
    of each search are kept within partitions before rows move, and only they meet the wide rows.
    """
    have = [c for c in BATCH_FILTERS if c in queries.columns]
    given = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in queries.columns else F.lit(default)
    plain = queries.select(
        "query_id", "query", F.struct(F.lit(0).alias("none"), *[_asked_for(BATCH_FILTERS[c][0], F.col(c)).alias(c) for c in have]).alias("filters"),
        (sum([F.col(c).isNotNull().cast("int") for c in have], F.lit(0)) > 0).alias("filtered"),
        given("tolerance_ms", 0).alias("tolerance"), given("sort", "relevance").alias("sort"), given("page", 1).alias("page"), given("per_page", per_query).alias("per_page"),
    )
    spec = normalize_search_log(plain, "query").withColumns({
        "low": F.coalesce("min_ms", "exact_ms") - F.col("tolerance"),
        "high": F.coalesce("max_ms", F.col("exact_ms") + F.col("window_ms") - 1) + F.col("tolerance"),
        "stems": F.array_sort(F.array_distinct(text.stemmed(expr.word_tokens(F.coalesce("keywords", F.lit("")))))),
        "like": _typed(F.coalesce("wildcard", F.lit(""))),
    })
    shape = ["stems", "low", "high", "like", "filtered", "filters", "sort"]
    # Written once: the table of searches is read on several ways, and what it asks for decides which of them there are.
    spec = written(spec.select("query_id", "page", "per_page", *shape, F.to_json(F.struct(*shape)).alias("key")), "searches")
    each = spec.groupBy("key").agg(F.max(F.col("page") * F.col("per_page")).alias("last"), *[F.any_value(c).alias(c) for c in shape])
    each = written(each.withColumn("search", F.monotonically_increasing_id()), "distinct-searches")
    worded, timed, like = F.size("stems") > 0, F.col("low").isNotNull() | F.col("high").isNotNull(), F.col("like").isNotNull()
    ways = {"words": worded, "windows": timed & ~worded, "stars": ~worded & ~timed & like, "whole": ~worded & ~timed & ~like & F.col("filtered")}
    asked = each.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in ways.items()], F.coalesce(F.max("last"), F.lit(0)).alias("last")).first()
    askers = spec.select("query_id", "page", "per_page", "key").join(each.select("key", "search"), "key").drop("key")
    each = each.drop("key")
    inside = (F.col("low").isNull() | (F.col("duration_ms") >= F.col("low"))) & (F.col("high").isNull() | (F.col("duration_ms") <= F.col("high")))

    columns = ["id", *_RANKED_BY, *sorted({"title", "artist", *[BATCH_FILTERS[c][1] for c in have]})]
    rows = tracks.repartition(int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")  # few files may hold many tracks
    if asked["words"] and index is None:
        words = F.concat(*[expr.word_tokens(expr.fold_accents(F.coalesce(F.col(c), F.lit("")))) for c in COLUMNS])
        rows = rows.select(*columns, F.array_distinct(text.stemmed(words)).alias("held"))
    elif asked["words"]:
        rows = rows.select(*columns).join(index.postings().groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("term").alias("held")), "id", "left")
    else:
        rows = rows.select(*columns)
    rows = written(rows, "tracks-asked")
    narrow = rows.select(*columns)

    # Numbers and equal values are compared before texts.
    met = F.lit(True)
    for c in sorted(have, key=lambda c: BATCH_FILTERS[c][0] in ("text", "part", "starts")):
        kind, of = BATCH_FILTERS[c]
        met = met & _meets(kind, F.col(f"filters.{c}"), F.col(of))
    met = met & (F.col("like").isNull() | F.coalesce(_holds(F.col("title"), F.col("like")), F.lit(False)) | F.coalesce(_holds(F.col("artist"), F.col("like")), F.lit(False)))
    found = []
    if asked["words"]:
        found.append(word_hits(each.filter(ways["words"]), rows).filter(inside))
    if asked["windows"]:
        found.append(ranges.range_join(each.filter(ways["windows"]).withColumns({"min_ms": F.col("low"), "max_ms": F.col("high")}), narrow))
    if asked["stars"]:
        found.append(wildcard_hits(each.filter(ways["stars"]), narrow))
    if asked["whole"]:
        every = each.filter(ways["whole"]).withColumns({"min_ms": F.lit(0).cast("long"), "max_ms": F.lit(None).cast("long")})
        placed = narrow.withColumns({"_ms": F.col("duration_ms"), "duration_ms": F.coalesce("duration_ms", F.lit(0).cast("long"))})  # without a time, too
        found.append(ranges.range_join(every, placed).withColumn("duration_ms", F.col("_ms")))
    kept = ["search", "sort", "last", "id", *_RANKED_BY]
    hits = each.limit(0).join(narrow, F.lit(False)).select(*kept) if not found else found[0].filter(met).select(*kept)
    for more in found[1:]:
        hits = hits.unionByName(more.filter(met).select(*kept))
    up = lambda c: F.when(F.col("sort") == c, F.lit(1)).otherwise(0)
    by_rank = F.when(F.col("sort") == "relevance", expr.rank_score(F.col("popularity"), F.col("search_count"))).desc_nulls_last()
    by_time = F.when(up("desc") == 1, -F.col("duration_ms")).otherwise(F.col("duration_ms"))
    w = Window.partitionBy("search").orderBy(by_rank, F.when((up("asc") == 1) & F.col("duration_ms").isNull(), 0).otherwise(1), by_time.asc_nulls_last(), F.col("id"))
    best = hits.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= asked["last"]).filter(F.col("position") <= F.col("last"))
    shown = best.select("search", "id", "position").join(tracks, "id")
    pages = shown.join(askers, "search").filter((F.col("position") > (F.col("page") - 1) * F.col("per_page")) & (F.col("position") <= F.col("page") * F.col("per_page")))
    return pages.select("id", "query_id", "position", *[c for c in tracks.columns if c != "id"])


def word_hits(spec: DataFrame, rows: DataFrame) -> DataFrame:
    """Searches ``(search, stems, ...)`` with the tracks whose stems ``held`` have all of theirs: a search meets those with its rarest stem, and they tell the rest."""
    asked = spec.select("search", F.explode("stems").alias("term"))
    terms = rows.select(F.explode("held").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    counts = terms.groupBy("term").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "term").groupBy("search").agg(F.min_by("term", F.struct("n", "term")).alias("term"))  # a stem that no track holds decides below
    met = written(spec.join(rarest, "search"), "worded-searches")
    return met.join(rows.withColumn("term", F.explode("held")), "term").filter(F.size(F.array_except("stems", "held")) == 0)


def _grams(c: Column, size: int) -> Column:
    """All runs of ``size`` characters; of a shorter text, none."""
    return F.when(F.length(c) >= size, F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substring(c, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


#: Parts of a run of characters, so that names with a common one are dealt to several tasks.
GRAM_PARTS = 16


def wildcard_hits(spec: DataFrame, rows: DataFrame) -> DataFrame:
    """Searches ``(search, like, ...)`` that are a wildcard alone, with their tracks.

    Runs of three characters of the distinct titles and artists are counted, those that are asked for; the rarest run of a core (or the core, if it is
    shorter) then meets the names that hold it, in parts, and the pattern decides. A track is met by its title, or else by its artist, so once.
    """
    names = rows.select(F.explode(F.array("title", "artist")).alias("name")).filter("name IS NOT NULL").distinct()
    low, core = F.lower(F.col("name")), F.col("like.core")
    asked = spec.select("search", "like", F.explode(F.array_distinct(F.when(F.length(core) >= 3, _grams(core, 3)).otherwise(F.array(core)))).alias("gram"))
    runs = names.select("name", F.explode(F.array_distinct(F.concat(*[_grams(low, n) for n in (1, 2, 3)]))).alias("gram"))
    runs = runs.join(asked.select("gram").distinct(), "gram", "left_semi")
    counts = runs.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "gram", "left").groupBy("search").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.any_value("like").alias("like"))
    rarest = rarest.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(GRAM_PARTS - 1))))
    found = rarest.join(runs.withColumn("part", F.pmod(F.hash("name"), F.lit(GRAM_PARTS))), ["gram", "part"]).filter(_holds(F.col("name"), F.col("like")))
    found = written(found.select("search", "name").join(spec, "search"), "names-found")
    by_title = found.join(rows, F.col("name") == F.col("title"))
    by_artist = found.join(rows, F.col("name") == F.col("artist")).filter(~F.coalesce(_holds(F.col("title"), F.col("like")), F.lit(False)))
    return by_title.unionByName(by_artist)

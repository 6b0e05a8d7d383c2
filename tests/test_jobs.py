"""Dump files, jobs on them, and properties of operators."""

import json

import pytest
from pyspark.sql import functions as F

from tracklens import queries as q
from tracklens.operators import relational as rel
from tracklens.operators.text import porter_stem
from tracklens.plans import enrich
from tracklens.schemas import DUMP_COLUMNS, TRACKS, tracks
from tracklens.sources import dumps

FILES = {
    "recording": ["1\tg1\tLove\t10\t260000\tlive", "2\tg2\tNo code\t10\t1000\t\\N", "3\tg3\tZero\t11\t0\t", "4\tg4\tPair\t11\t200000x\t\\N", "5\tg5", "6\tg6\tGroup only\t12\t5000\t\\N"],
    "artist_credit": ["10\tAbba", "11\tA & B", "12\tSolo"],
    "artist_credit_name": ["10\t0\t100", "11\t1\t102", "11\t0\t101", "12\t0\t103"],
    "isrc": ["7\t1\tI7\t\\N\t0", "5\t1\tI5\t\\N\t0", "8\t3\tI8\t\\N\t0", "9\t4\tI9\t\\N\t0", "11\t6\tI11\t\\N\t0"],
    "genre": ["1\tx\tRock", "2\tx\tpop", "3\tx\tjazz", "4\tx\tsoul", "5\tx\tfunk", "6\tx\tfolk"],
    "tag": ["1\trock", "2\tpop", "3\tjazz", "4\tsoul", "5\tfunk", "6\tfolk", "7\tseen live"],
    "recording_tag": ["1\t1\t9", "1\t2\t8", "1\t3\t7", "1\t4\t6", "1\t5\t5", "1\t6\t5", "1\t7\t99", "4\t1\t0"],
    "release_group_tag": ["50\t2\t3", "51\t3\t1"],
    "artist_tag": ["101\t4\t2", "103\t5\t2"],
    "medium": ["20\t31", "21\t30", "22\t32"],
    "track": ["1\tt1\t1\t20\t3", "2\tt2\t1\t21\t7", "3\tt3\t4\t22\t1", "4\tt4\t6\t20\t2"],
    "release": ["30\tr\tFirst\t10\t50\t1\t1\t1", "31\tr\tSecond\t10\t51\t1\t1\t2", "32\tr\tThird\t10\t52\t1\t1\t\\N"],
    "release_country": ["30\t1\t1980", "30\t2\t1979", "31\t1\t\\N"],
    "release_unknown_country": ["30\t1985", "32\t1990"],
    "release_label": ["1\t30\t61", "2\t30\t60", "3\t31\t60"],
    "label": ["60\tl\tBig", "61\tl\t\\N"],
    "release_group": ["50\tg\tn\t10\t1", "51\tg\tn\t10\t\\N", "52\tg\tn\t10\t9"],
    "release_group_primary_type": ["1\tAlbum"],
    "language": ["1\teng\ta\tb\tc\td\tEnglish", "2\tdeu\ta\tb\tc\td\tGerman"],
    "area": ["70\tg\tSweden"],
    "artist": ["100\tg\tn\t\t\t\t\t\t\t\t2\t70\t\\N", "101\tg\tn\t\t\t\t\t\t\t\t1\t\\N\t2", "103\tg\tn\t\t\t\t\t\t\t\t\\N\t\\N\t\\N"],
}


@pytest.fixture(scope="module")
def dump(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("dump")
    for name, lines in FILES.items():
        (folder / name).write_text("\n".join(lines) + "\n")
    return {t: dumps.read_dump(spark, str(folder), t) for t in FILES}


@pytest.fixture(scope="module")
def imported(spark, dump):
    return enrich.import_catalogue(dump, spark.createDataFrame([], TRACKS)).cache()


def test_read_dump(dump):
    got = {r.id: r for r in dump["recording"].collect()}
    assert set(got) == {1, 2, 3, 4, 6} and got[4].length == 200000 and got[2].comment is None and got[3].comment is None
    assert all(len(c.split()) > 1 for c in DUMP_COLUMNS.values())


def test_import(spark, dump, imported):
    got = {r.id: r for r in imported.collect()}
    assert set(got) == {1, 4, 6} and got[1].isrc == "I5" and got[1].artist == "Abba" and got[1].version == "live"
    assert enrich.import_catalogue(dump, imported).count() == 0
    assert tuple(enrich.import_delta(dump, imported.limit(0), True).first()) == (3, 3, 9, 9e-06)


def test_enrich_release(dump, imported):
    got = {r.id: r for r in enrich.enrich_release(imported, dump).collect()}
    assert (got[1].album, got[1].release_year, got[1].label, got[1].release_type, got[1].track_number) == ("First", 1979, "Big", "Album", 7)
    assert (got[4].album, got[4].release_year, got[4].release_type) == ("Third", 1990, "Other") and got[6].release_type == "Other"


def test_enrich_genre(dump, imported):
    got = {r.id: r.genre for r in enrich.enrich_genre(imported, dump).collect()}
    assert got == {1: "rock, pop, jazz, soul, folk", 4: "soul", 6: "jazz"}


def test_enrich_artist(dump, imported):
    got = {r.id: r for r in enrich.enrich_artist(imported, dump).collect()}
    assert (got[1].artist_type, got[1].artist_country, got[1].language, got[1].language_code) == ("Group", "Sweden", "English", "eng")
    assert (got[4].artist_type, got[4].artist_gender, got[4].language) == ("Person", "Female", None) and got[6].language == "German"


def test_enrich_audio(spark, imported, tmp_path):
    (tmp_path / "r.csv").write_text('mbid,danceability,bpm\n"g1",,\n"g1",1.5,120.0\ng9,1,1\ng4,x,100abc\n')
    (tmp_path / "t.csv").write_text("mbid,key_key,key_scale,tuning_frequency\ng6,A,minor,441.5\n")
    (tmp_path / "l.csv").write_text("mbid,average_loudness,dynamic_complexity\ng1,0.5,-\n")
    r = dumps.read_features_csv(spark, f"{tmp_path}/r.csv", {"bpm": "bpm", "danceability": "danceability"})
    t = dumps.read_features_csv(spark, f"{tmp_path}/t.csv", {"key_key": "key_key", "key_scale": "key_scale", "tuning_frequency": "tuning_freq"})
    lo = dumps.read_features_csv(spark, f"{tmp_path}/l.csv", {"average_loudness": "loudness", "dynamic_complexity": "dynamic_complexity"})
    got = {x.mb_id: x for x in enrich.enrich_audio(imported, r, t, lo).collect()}
    assert (got["g1"].bpm, got["g1"].danceability, got["g1"].loudness, got["g1"].dynamic_complexity) == (120.0, 1.5, 0.5, None)
    assert got["g4"].bpm == 100.0 and got["g4"].danceability is None and (got["g6"].key_key, got["g6"].tuning_freq) == ("A", 441.5)


def test_lookup_and_review(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"mb_id": f"g{i}", "listeners": i, "status": "ok"}) for i in range(3)))
    assert dumps.lookup_source(spark, f"{tmp_path}/a.json", "mb_id string, listeners long, status string").filter("listeners > 0").count() == 2
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id long, title string")
    dumps.write_review(df, f"{tmp_path}/review")
    assert sorted(map(tuple, dumps.read_review(spark, f"{tmp_path}/review", "id long, title string").collect())) == [(1, "a b"), (2, None)]
    first = dumps.stage(df, f"{tmp_path}/stage")
    assert dumps.stage(df.limit(0), f"{tmp_path}/stage").count() == first.count() == 2


def test_properties(spark, tiny):
    t = tracks(spark, tiny)
    assert rel.headline(t).agg(F.sum("version_count")).first()[0] == t.count()
    pages = [r.id for n in (1, 2, 3, 4) for r in rel.page(t, rel.relevance_order(), n, 50).orderBy("position").collect()]
    assert pages == [r.id for r in t.orderBy(*rel.relevance_order()).collect()][:200]
    upd = t.filter("id % 2 = 0").select("id", F.lit("x").alias("genre"))
    once = rel.apply_updates(t.select("id", "genre"), upd, "id", {"genre": "overwrite"})
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, rel.apply_updates(once, upd, "id", {"genre": "overwrite"}).collect()), key=str)
    new = rel.insert_ignore(t.select("mb_id"), t.filter("id < 50").select("mb_id"), "mb_id")
    assert rel.only_new(new, t.select("mb_id"), "mb_id").count() == 0 and new.count() == t.count() - 50


def test_page_plan(spark, tiny):
    plan = rel.page(tracks(spark, tiny), rel.relevance_order(), 2, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    plan = rel.top_n_per(tracks(spark, tiny), "artist", [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("word, stem", [x.split(":") for x in "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration digitizer:digit operator:oper feudalism:feudal triplicate:triplic formative:form hopeful:hope goodness:good revival:reviv allowance:allow inference:infer adjustment:adjust adoption:adopt homologous:homolog effective:effect rate:rate cease:ceas controll:control roll:roll missing:miss".split()])
def test_porter(word, stem):
    assert porter_stem(word) == stem


def test_batch_wildcards(spark, tiny):
    """Wildcards alone, with words and with times, against every track."""
    from tracklens.plans import search

    rows = tracks(spark, tiny).select("id", "title", "artist", "album", "duration_ms").collect()
    first = rows[0].title.split()[0]
    asked = [(1, "*ol*"), (2, f"{first} *ol*"), (3, "*ol* >3:05"), (4, "b*"), (5, "*#3"), (6, "*"), (7, "*zzzqqq*"), (8, "*in*")]
    has = {1: ("ol", 1, 1), 2: ("ol", 1, 1), 3: ("ol", 1, 1), 4: ("b", 0, 1), 5: ("#3", 1, 0), 8: ("in", 1, 1)}
    want = set()
    for q, (core, before, after) in has.items():
        for r in rows:
            match = any(core in n[before : len(n) - after] if before and after else n.startswith(core) and len(n) > len(core) if after else n.endswith(core) and len(n) > len(core) for n in (r.title.lower(), r.artist.lower()))
            words = f"{r.title} {r.artist} {r.album}".lower().split()
            if match and (q != 2 or first.lower() in words) and (q != 3 or r.duration_ms >= 185_000):
                want.add((q, r.id))
    df = spark.createDataFrame(asked, "query_id long, query string")
    assert {(r.query_id, r.id) for r in search.batch_search(df, tracks(spark, tiny), 10_000).collect()} == want and len({q for q, _ in want}) >= 5


def test_scan_all_ids(spark, tiny):
    t = tracks(spark, tiny)
    assert sorted(r.id for r in q.QUERIES["a3_scan_all_ids"](spark, tiny).collect()) == sorted(r.id for r in t.select("id").collect())


def test_repeated_keys_repeat_no_rows(spark):
    """Several updates of a key, or several answers of a service, leave one row for each track."""
    from tracklens.operators import relational as rel

    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, genre string")
    updates = spark.createDataFrame([(1, "z"), (1, "y"), (1, None), (2, None), (2, None)], "id long, genre string")
    get = lambda how: {r.id: r.genre for r in rel.apply_updates(base, updates, "id", {"genre": how}).collect()}
    assert rel.apply_updates(base, updates, "id", {"genre": "overwrite"}).count() == 3
    assert get("overwrite") == {1: "y", 2: None, 3: "c"} and get("keep_non_null") == {1: "y", 2: "b", 3: "c"}
    tracks = spark.createDataFrame([(1, "m", "A", "T")], "id long, mb_id string, artist string, title string")
    by_id = spark.createDataFrame([], "mb_id string, listeners long, status string")
    by_name = spark.createDataFrame([("a", "t", 10, "ok"), ("A", "T", 5000000, "ok")], "artist string, title string, listeners long, status string")
    second = spark.createDataFrame([("m", 1, "ok"), ("m", 2, "ok")], "mb_id string, total_user_count long, status string")
    rows = rel.popularity_cascade(tracks, by_id, by_name, second).collect()
    assert [(r.new_popularity, r.new_source) for r in rows] == [(100, "lastfm")]


STEMMED = [(1, "Loving You", "A", "x"), (2, "love", "B", "loved"), (3, "glove", "Lover", "y"), (4, "Lové", "C", "z"), (5, "you loves", "D", "w"), (6, None, None, "relational loves")]


def test_searches_stem(spark, tmp_path):
    """Searches in one plan, with a stored index and in a batch find every word of the same stem, as a pass over all rows does."""
    from tracklens.operators import word_index
    from tracklens.operators.filters import SearchSpec
    from tracklens.plans import search

    t = spark.createDataFrame(STEMMED, "id long, title string, artist string, album string").withColumn("duration_ms", F.lit(1).cast("long"))
    t = rel.ensure_columns(t, TRACKS)
    fold = lambda x: (x or "").lower().replace("é", "e")
    index = word_index.store_index(t, "id", search.COLUMNS, f"{tmp_path}/index")
    stems = lambda x: {porter_stem(w) for w in x.lower().split()}
    asked = dict(enumerate(("LOVES you", "relate", "nothing", "loving", "lover")))
    want = {k: {r[0] for r in STEMMED if stems(a) <= stems(" ".join(fold(c) for c in r[1:]))} for k, a in asked.items()}
    assert {r.id for r in search.search_tracks(t, SearchSpec(keywords=asked[0], per_page=50)).collect()} == want[0] == {1, 5}
    assert {r.id for r in search.search_tracks(t, SearchSpec(keywords=asked[3], per_page=50), index).collect()} == want[3]
    batch = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    assert {(r.query_id, r.id) for r in search.batch_search(batch, t).collect()} == {(k, i) for k, ids in want.items() for i in ids}
    assert search.answer(t, SearchSpec(keywords="you loving", per_page=50), index).collect()[0].stemmed_word == "loving"
    assert {(r.query_id, r.id) for r in search.batch_search(batch, t, index=index).collect()} == {(k, i) for k, ids in want.items() for i in ids}
    plan = index.postings(["love"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(EqualTo(term,love)" in plan or "EqualTo(term,love)" in plan
    assert {(r.doc_id, r.length) for r in index.lengths().collect()} == {(r[0], sum(len(fold(c).split()) for c in r[1:])) for r in STEMMED}


# ---- the stored index and the catalogue ------------------------------------------------------


def test_updates_equal_a_new_index_and_touch_only_their_ranges(spark, tmp_path):
    """After inserts, changes and deletes, before and after compaction, and after a change that died half-way."""
    from tracklens.operators import word_index

    words = [f"{a}{b}" for a in "abcdefghij" for b in ("ing", "ed", "s", "")]
    rows = [(i, f"{words[i % 40]} common", words[i * 7 % 40]) for i in range(400)]
    table = lambda r: spark.createDataFrame(r, "id long, title string, artist string")
    index = word_index.store_index(table(rows), "id", ["title", "artist"], f"{tmp_path}/index")
    files = lambda: {p.name for p in (tmp_path / "index" / "postings").rglob("*.parquet")}
    first, held = files(), index.postings()
    now = [(i, "zebra zebras" if i == 5 else t, a) for i, t, a in rows if i not in (7, 8)] + [(900, "Zébra common", None)]
    changed, gone = word_index.changed_text(table(rows), table(now), ["title", "artist"])
    assert {r.id for r in changed.collect()} == {5, 900} and {r.id for r in gone.collect()} == {7, 8}
    index.update(changed, gone)
    fresh = word_index.store_index(table(now), "id", ["title", "artist"], f"{tmp_path}/fresh")
    same = lambda: sorted(map(tuple, index.postings().collect())) == sorted(map(tuple, fresh.postings().collect())) and sorted(map(tuple, index.lengths().collect())) == sorted(map(tuple, fresh.lengths().collect()))
    assert same() and files() == first
    assert {r.doc_id for r in index.postings(["zebra"]).collect()} == {5, 900} and {r.doc_id for r in index.postings(prefixes=["zeb"]).collect()} == {5, 900}
    touched = index.compact()
    assert same() and 0 < len(touched) < len(index.manifest()["ranges"]) and first < files() and index.compact() == []
    assert all(g == 0 for r, g in index.manifest()["ranges"].items() if int(r) not in touched)
    assert held.count() == 400 * 3  # a reader from before goes on with what it began with
    # A version that was written but not committed is not seen, and its number is taken by the next.
    table([(1, "lost", "lost")]).select(F.col("id").alias("doc_id")).write.parquet(f"{tmp_path}/index/marks/version=2")
    assert same()
    index.update(table([(1, "found", "found")]))
    assert {r.doc_id for r in index.postings(["found"]).collect()} == {1} and index.postings().filter("doc_id = 1").count() == 2


def test_a_prefix_reads_its_ranges_only(spark, tmp_path):
    from tracklens.operators import text, word_index

    rows = [(i, f"w{i % 97:02d}a x{i % 13}") for i in range(2000)]
    index = word_index.store_index(spark.createDataFrame(rows, "id long, title string"), "id", ["title"], f"{tmp_path}/index", stem=False)
    found = index.postings(prefixes=["w1"])
    assert {r.doc_id for r in text.match_column(found, "title", ["w1"]).collect()} == {i for i in range(2000) if 10 <= i % 97 < 20}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(term,w1)" in plan and len(found.inputFiles()) < len(index.postings().inputFiles()) / 2
    assert index.postings(prefixes=["none"]).count() == 0 and index.postings([]).count() == 0
    empty = word_index.store_index(spark.createDataFrame([], "id long, title string"), "id", ["title"], f"{tmp_path}/empty")
    assert empty.postings(["a"]).count() == empty.postings().count() == empty.lengths().count() == 0


def test_the_best_of_a_search_are_cut_before_rows_move(spark, tiny):
    from tracklens.plans import search

    t = tracks(spark, tiny)
    asked = spark.createDataFrame([(1, ">0:01"), (2, "blue")], "query_id long, query string")
    plan = search.batch_search(asked, t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_batch_filters_equal_single_searches(spark, tiny):
    """Every filter, with and without words and windows, and filters alone."""
    from tracklens.operators.filters import SearchSpec
    from tracklens.plans import search

    t = tracks(spark, tiny).withColumn("duration_ms", F.expr("CASE WHEN id % 50 = 1 THEN NULL ELSE duration_ms END"))
    kinds = {
        "title": "blu*", "artist": "*5", "genre": "*", "label": "label 1*", "country": "*an*", "language": "en", "year_from": 1990, "year_to": 2000, "bpm_min": 20.0, "bpm_max": 99.5, "release_type": "Album",
        "artist_type": "Group", "artist_gender": "Female", "title_len_min": 9, "title_len_max": 10, "artist_len_min": 8, "artist_len_max": 7, "title_starts": "Red*", "artist_starts": "brand#1",
    }
    cases = [(q_, c) for q_ in ("", "blue", "3:10") for c in kinds]
    schema = ", ".join(f"{c} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for c, v in kinds.items())
    rows = [(i, q_, *[v if k == c else None for k, v in kinds.items()], 300) for i, (q_, c) in enumerate(cases)]
    got = {}
    for r in search.batch_search(spark.createDataFrame(rows, f"query_id long, query string, {schema}, per_page int"), t).collect():
        got.setdefault(r.query_id, []).append((r.position, r.id))
    some = 0
    for i, (q_, c) in enumerate(cases):
        if q_ == "" and c == "genre":
            assert i not in got or len(got[i]) == t.count()  # stars alone filter nothing
            continue
        spec = SearchSpec(**{c: kinds[c]}, per_page=300, keywords=q_ if q_ == "blue" else None, min_ms=190_000 if q_ == "3:10" else None, max_ms=190_999 if q_ == "3:10" else None)
        want = [(r.position, r.id) for r in search.search_tracks(t, spec).collect()] if q_ != "blue" else None
        mine = sorted(got.get(i, []))
        if want is None:
            want = {r.id for r in search.search_tracks(t, spec).collect()}
            assert {x for _, x in mine} == want, (q_, c)
        else:
            assert mine == want, (q_, c)
        some += bool(mine)
    assert some > 25


def test_searches_that_ask_the_same_are_answered_once(spark, tiny, monkeypatch):
    """Forty askers of three searches: words meet the tracks for one search each, and every asker gets its own page."""
    from tracklens.plans import search

    t, met, plain = tracks(spark, tiny), [], search.word_hits
    monkeypatch.setattr(search, "word_hits", lambda spec, rows: (met.append(spec.count()), plain(spec, rows))[1])
    texts = ["blue", "BLUE ", "ring *#1*", "blue >3:01"]
    rows = [(i, texts[i % 4], 1 + i // 4 % 3, 3) for i in range(40)]
    got = {}
    for r in search.batch_search(spark.createDataFrame(rows, "query_id long, query string, page int, per_page int"), t).collect():
        got.setdefault(r.query_id, []).append((r.position, r.id))
    assert met == [3]
    every = {}
    for r in search.batch_search(spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "query_id long, query string"), t, 9).collect():
        every.setdefault(r.query_id, []).append((r.position, r.id))
    want = {i: [p for p in sorted(every.get(i % 4, [])) if (n - 1) * 3 < p[0] <= n * 3] for i, _, n, _ in rows}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v} and len(got) >= 30

"""Streams against tables, and the stateful operator against a sequential pass."""

import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connect
from tracklens import file_queries, queries as q
from tracklens.schemas import read, tracks
from tracklens.sources import staging
from tracklens.streaming import cache, ops, packets


def run(spark, tmp_path, df, op, mode, files=3):
    """The results of an operator, batch by batch, on a stream of the rows, which arrive in so many files."""
    df.repartition(files).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = []
    ops.run_available(op(stream), f"{tmp_path}/ck", lambda b, i: out.append([tuple(r) for r in b.collect()]), mode)
    return out


def test_counter(spark, tiny, tmp_path):
    df = q.requests(spark, tiny)
    assert run(spark, tmp_path, df, ops.search_counter, "complete")[-1] == [(df.count(),)]


@pytest.mark.parametrize("op", [ops.search_credit, ops.priority_bump])
def test_impressions(spark, tiny, tmp_path, op):
    df, t = q.impressions(spark, tiny), tracks(spark, tiny)
    want = {tuple(round(x, 9) for x in r) for r in op(df, t).collect()}
    got = {}
    for batch in run(spark, tmp_path, df, lambda s: op(s, t), "update"):
        got.update({r[0]: tuple(round(x, 9) for x in r) for r in batch})
    assert set(got.values()) == want


def test_credit_rules(spark):
    t = spark.createDataFrame([(1, None), (2, "unfound"), (3, "lastfm")], "id long, popularity_source string")
    rows = [(1, 1, 2, "tracks"), (1, 2, 2, "tracks"), (1, 3, 2, "tracks"), (2, 1, 20_000, "tracks"), (3, 1, 1, "artists")]
    i = spark.createDataFrame(rows, "search_id long, track_id long, raw_count int, mode string")
    assert {r.track_id: r.credit for r in ops.search_credit(i, t).collect()} == {1: 0.5 + 1 / 10_001, 2: 0.5}
    assert [r.track_id for r in ops.priority_bump(i, t).collect()] == [1]


def test_rate_limit(spark, tiny, tmp_path):
    df = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:{s:02d}", "a" if m else "b") for m, n in ((0, 3), (1, 4), (40, 1)) for s in range(n)], "ts string, client string").withColumn("ts", F.to_timestamp("ts"))
    want = {tuple(r) for r in ops.rate_limit_flags(df, 3).collect()}
    assert len(want) == 1 and {r for b in run(spark, tmp_path, df, lambda s: ops.rate_limit_flags(s, 3), "append", files=1) for r in b} == want


def sequential(rows, ttl):
    first, kept = {}, set()
    for key, ms, event in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in first or ms >= first[key] + ttl:
            first[key] = ms
            kept.add((key, event))
    return kept


def test_cached_dedup(spark, tiny):
    got = {tuple(r) for r in file_queries.dedup_stream(spark, tiny).collect()}
    rows = read(spark, tiny, "events").select("event_type", F.unix_millis(F.col("ts").cast("timestamp")), "event_id").collect()
    assert got == sequential([tuple(r) for r in rows], 300_000)
    edges = [("k", t * 1000, i) for i, t in enumerate((0, 299, 300, 301, 599, 600))]
    assert sequential(edges, 300_000) == {("k", 0), ("k", 2), ("k", 5)}


def test_cached_dedup_by_client(spark, tiny):
    got = {tuple(r) for r in q.QUERIES["k4_cached_dedup_by_client"](spark, tiny).collect()}
    rows = read(spark, tiny, "events").select(F.expr(file_queries.CLIENT_KEY), F.unix_millis(F.col("ts").cast("timestamp")), "event_id").collect()
    assert got == sequential([tuple(r) for r in rows], 300_000)


def batches_of(spark, rows, cuts):
    schema = "key string, ms long, event_id long"
    return [spark.createDataFrame(rows[a:b], schema) for a, b in zip([0, *cuts], [*cuts, len(rows)])]


def test_batches_equal_one_and_may_be_run_again(spark, tmp_path):
    """Whatever a stream is cut into, and if a batch is run twice, the result is that of one pass."""
    import random

    r = random.Random(3)
    rows = sorted([(r.choice(["a", "b", None, "c"]), r.randrange(0, 5_000_000), i) for i in range(900)] + [("a", 100, 1000), ("a", 100, 1001)], key=lambda x: (x[1], x[2]))
    want = sequential(rows, 300_000)
    assert {tuple(x) for x in cache.cached_dedup(spark.createDataFrame(rows, "key string, ms long, event_id long")).collect()} == want
    for k, cuts in enumerate(([450], [1, 2, 300, 301, 899], [])):
        dedup = cache.CachedDedup(spark, f"{tmp_path}/{k}")
        for number, batch in enumerate(batches_of(spark, rows, cuts)):
            dedup.process(batch, number)
            dedup.process(batch, number)
        assert {tuple(x) for x in dedup.kept().collect()} == want


def test_state_goes_when_no_answer_lives(spark, tmp_path):
    dedup = cache.CachedDedup(spark, f"{tmp_path}/s", ttl_seconds=300, lateness_seconds=60)
    rows = [("a", 0, 1), ("b", 100_000, 2), ("c", 359_999, 3), ("c", 10_000_000, 4)]
    for number, batch in enumerate(batches_of(spark, rows, [3, 3, 4])):  # the second batch is empty
        dedup.process(batch, number)
    assert {tuple(r) for r in dedup.state(0).collect()} == {("a", 0), ("b", 100_000), ("c", 359_999)}
    assert dedup.state(1).count() == 3 and {tuple(r) for r in dedup.state(2).collect()} == {("c", 10_000_000)}


def test_one_key_with_many_rows_moves_one_row_for_each_time(spark):
    """A million requests of one key at a hundred times: what is dealt by key are the hundred."""
    df = spark.range(1_000_000).select(F.concat(F.lit("k"), (F.col("id") % 1).cast("string")).alias("key"), (F.col("id") % 100 * 10_000).alias("ms"), F.col("id").alias("event_id"))
    assert {r.event_id for r in cache.cached_dedup(df).collect()} == {0, 30, 60, 90}
    plan = cache.cached_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.index("MapInArrow") < plan.index("Exchange hashpartitioning(key#")


# ---- packets ---------------------------------------------------------------------------------

GID = "{:08d}-0000-4000-8000-000000000000"


def land(spark, folder, number, gids, op="i"):
    line = lambda *c: "\t".join(map(str, c))
    for table, lines in (
        ("dbmirror_pending", [line(i, '"musicbrainz"."recording"', op, i) for i in range(len(gids))]),
        ("dbmirror_pendingdata", [line(i, "f", f"\"gid\" = '{GID.format(g)}'") for i, g in enumerate(gids)]),
    ):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{folder}.landing/{number}/{table}")
    staging.moved(spark, f"{folder}.landing/{number}", f"{folder}/{number}")


@pytest.fixture()
def answers(spark):
    schema = "id string, title string, length long, disambiguation string, isrcs array<string>, `artist-credit` array<struct<name: string, joinphrase: string, artist: struct<name: string>>>, releases array<struct<title: string, date: string>>"
    credit = [("A", " & ", ("x",)), (None, "", ("B",))]
    rows = [(GID.format(g), f"t{g}", 1000 * g, "", [f"I{g}", "Z"] if g != 4 else [], credit, [("late", "2001"), ("early", "1999-05")]) for g in range(1, 9)]
    return spark.createDataFrame(rows, schema)


def test_packets_go_by_their_numbers(spark, tmp_path, answers):
    folder, state = f"{tmp_path}/log", f"{tmp_path}/state"
    existing = spark.createDataFrame([(GID.format(2),)], "mb_id string")
    begin = lambda: packets.PacketSync(spark, folder, state, answers, existing)
    assert begin().run() == [] and begin().position() is None and begin().tracks().count() == 0
    land(spark, folder, 7, [1])
    assert begin().run() == [] and begin().position() == 7  # noted, not read
    land(spark, folder, 10, [3, 6])
    assert begin().run() == [] and begin().tracks().count() == 0  # 8 and 9 are missing
    land(spark, folder, 8, [2, 3, 3, 4, 99])
    assert begin().run() == [8]
    land(spark, folder, 9, [5], op="u")
    sync = begin()
    sync.follow(f"{tmp_path}/offsets")
    assert sync.position() == 10 and sync.run() == []
    assert {(r.mb_id, r.isrc, r.artist, r.album, r.release_year) for r in sync.tracks().collect()} == {(GID.format(g), f"I{g}", "A & B", "early", 1999) for g in (3, 6)}
    assert {(r.mb_id, r.priority, r.packet) for r in sync.queue().collect()} == {(GID.format(3), 0, 8), (GID.format(6), 0, 10)}
    assert {tuple(r) for r in sync.summary().collect()} == {(8, 1, 1, 2, 0), (10, 1, 1, 0, 0)}


def test_a_packet_that_was_cut_off_is_taken_again(spark, tmp_path, answers, monkeypatch):
    folder = f"{tmp_path}/log"
    sync = packets.PacketSync(spark, folder, f"{tmp_path}/state", answers, spark.createDataFrame([], "mb_id string"), start=0)
    land(spark, folder, 1, [1, 2])
    land(spark, folder, 2, [2, 3])
    real = packets.mark

    def dies(s, path, text=""):
        if path.endswith("/position/2"):
            raise RuntimeError("lost")
        real(s, path, text)

    monkeypatch.setattr(packets, "mark", dies)
    with pytest.raises(RuntimeError):
        sync.run()
    assert sync.position() == 1 and sync.tracks().count() == 2  # what was written of 2 is not seen
    monkeypatch.setattr(packets, "mark", real)
    assert sync.run() == [2] and sync.tracks().count() == sync.tracks().select("mb_id").distinct().count() == 3
    with pytest.raises(FileExistsError):
        staging.mark(spark, f"{tmp_path}/state/position/2")


def test_a_time_without_a_zone_is_counted_as_it_stands(spark, tmp_path):
    """Wherever the session is: 02:30 of a night that has no such hour there is an hour before 03:30, so both requests are kept."""
    rows = "SELECT * FROM VALUES (1L, 'view', TIMESTAMP_NTZ'2024-03-10 02:30:00'), (2L, 'view', TIMESTAMP_NTZ'2024-03-10 03:30:00'), (3L, 'view', TIMESTAMP_NTZ'2024-03-10 03:34:59.999') AS t(event_id, event_type, ts)"
    spark.sql(rows).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert {r.event_id for r in q.QUERIES["k4_cached_dedup"](spark, str(tmp_path)).collect()} == {1, 2}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_times_between_milliseconds_are_rounded_as_in_the_sql(spark, tmp_path):
    """An answer of 300 seconds by the nearest millisecond is over, one of half a millisecond less is not; before 1970 as well, and with a zone."""
    times = {"a": (0, 299_999_600, 300_000_400), "b": (400, 299_999_400, 299_999_500), "c": (600, 300_000_400, 300_000_600), "d": (-600_000_600, -300_000_700, -300_000_500, -300_000_400), "e": (900, 1_100, 300_001_000)}
    rows = ", ".join(f"({10 * k + i}L, '{key}', {us}L)" for k, (key, own) in enumerate(times.items()) for i, us in enumerate(own))
    for kind in ("TIMESTAMP_NTZ", "TIMESTAMP"):
        folder = f"{tmp_path}/{kind}"
        at = f"{kind}'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, us / 1000000BD) AS ts"
        spark.sql(f"SELECT event_id, event_type, 1L AS user_id, {at} FROM VALUES {rows} AS t(event_id, event_type, us)").coalesce(1).write.parquet(f"{folder}/events.parquet")
        for name in ("k4_cached_dedup", "k4_cached_dedup_by_client"):
            assert compare(q.QUERIES[name](spark, folder), connect(folder), q.ORACLES[name]) == ""
        assert {r.event_id for r in q.QUERIES["k4_cached_dedup"](spark, folder).collect()} == {0, 1, 10, 12, 20, 22, 30, 31, 40, 42}

"""What the contracts of ranked search, exact dedup and fill-in-middle do not show: bounds, arrivals, marks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import plain
from tracklens.llm import exact_dedup, fim, ranked

# ---- ranked search -------------------------------------------------------------------------


def searches_and_chunk(seed, docs=300, terms=60, searches=12):
    r = random.Random(seed)
    own = [np.array(sorted(r.sample(range(terms), r.randint(1, 15)))) for _ in range(searches)]
    s = ranked.Searches(own, np.array([r.randint(1, 9000) for _ in range(terms)]))
    asked = sorted({int(t) for n in own for t in n})
    rows = [sorted({r.choice(asked) if r.random() < 0.5 else r.choice(asked[-5:]) for _ in range(r.randint(1, 30))}) for _ in range(docs)]
    first = np.cumsum([0, *map(len, rows)])
    return s, rows, ranked.chunk_of(pa.array(range(docs), pa.int64()), first, np.array(sum(rows, [])), np.array([r.randint(1, 999_999) for _ in range(first[-1])]), s)


def scores(s, rows, c):
    impact = [dict(zip(row, c.impact[c.first[d] : c.first[d + 1]].tolist(), strict=True)) for d, row in enumerate(rows)]
    return [[sum(int(s.weight[t]) * i.get(t, 0) for t in own.tolist()) for i in impact] for own in s.numbers]


@pytest.mark.parametrize("seed", range(5))
def test_blocks_hold_every_posting_and_bounds_every_score(seed):
    s, rows, c = searches_and_chunk(seed)
    for k, t in enumerate(c.list_term.tolist()):
        blocks = range(c.list_first[k], c.list_first[k + 1])
        members = [c.member[c.member_first[b] : c.member_first[b + 1]].tolist() for b in blocks]
        assert sorted(sum(members, [])) == [d for d, row in enumerate(rows) if t in row]
        assert max(map(len, members)) <= ranked.BLOCK_DOCS
    want = scores(s, rows, c)
    for k, (_, searches, _, _), bound in ranked._Scorer(c, s).bounds():
        t = int(c.list_term[k])
        for b in range(len(bound)):
            docs = c.member[c.member_first[c.list_first[k] + b] : c.member_first[c.list_first[k] + b + 1]].tolist()
            for j, q in enumerate(searches.tolist()):
                whole = [d for d in docs if not set(rows[d]) & set(s.numbers[q][s.numbers[q] < t].tolist())]
                assert all(want[q][d] <= bound[b, j] for d in whole)


@pytest.mark.parametrize("seed", range(5))
def test_scan_finds_the_ten_best_of_every_search(seed):
    s, rows, c = searches_and_chunk(seed)
    best = ranked.Best(np.ones(len(s.numbers), np.int64))
    ranked.probe(c, s, best)
    known = best.least.copy()
    assert (known > 1).any()
    found = ranked.Best(known)
    ranked.scan(c, s, found)
    for q, row in enumerate(scores(s, rows, c)):
        want = sorted((-x, d) for d, x in enumerate(row) if x)[:10]
        mine = found.search == q
        assert sorted(zip((-found.score[mine]).tolist(), found.doc_id[mine].tolist(), strict=True)) == want


def test_many_equal_documents_and_blocks_of_searches(spark, monkeypatch):
    """A third of the rows are one text, ids are null or equal, and the searches need several passes."""
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 2)
    rows = [(None if i % 7 == 0 else i // 2, "alpha beta gamma" if i % 3 == 0 else f"alpha w{i % 13} w{i % 5} beta") for i in range(400)]
    items = [(i, t) for i, t in enumerate(["alpha", "beta gamma", "w3 w4", "w12 zeta", "zeta", None, "alpha", "w0 w1 w2 w3"])]
    found = ranked.search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, plain.ranked(rows, items)))


# ---- exact dedup -----------------------------------------------------------------------------


def test_later_arrivals_are_held_against_the_index(spark):
    index = exact_dedup.temporary_index(spark)
    schema = "doc_id long, text string, kept string"
    first = exact_dedup.deduplicate(spark.createDataFrame([(5, "a b", "x"), (9, "a\tb", "y"), (7, "c", "z")], schema), index)
    assert first.columns == ["doc_id", "text", "keep_id", "group_size", "kept", "text_sha256"]
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in first.collect()} == {(5, 5, 2, True), (9, 5, 2, False), (7, 7, 1, True)}
    later = spark.createDataFrame([(1, "a  b", ""), (2, "d", ""), (3, "d", ""), (7, "c", "")], schema)
    want = {(1, 5, 1, False), (2, 2, 2, True), (3, 2, 2, False), (7, 7, 1, True)}
    for _ in range(2):  # a run that was lost after its append is done again
        assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(later, index).collect()} == want
    assert index.rows().count() == 3
    # Another session takes the files over.
    again = exact_dedup.DigestIndex(spark, index.name + "_again", index.path).create()
    assert {r.keep_id for r in again.rows().collect()} == {2, 5, 7}
    again.drop()


def test_the_index_side_of_the_anti_join_is_not_shuffled(spark):
    index = exact_dedup.temporary_index(spark)
    exact_dedup.deduplicate(spark.range(50).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")), index).collect()
    groups = spark.range(99).select(exact_dedup.digest(F.col("id").cast("string")).alias("digest"), F.col("id").alias("keep_id"))
    plan = index.new(groups)._jdf.queryExecution().executedPlan().toString()
    right = plan[plan.rindex("FileScan") :]
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in right and plan.count("Exchange hashpartitioning") == 1


def test_a_row_for_every_digest_in_its_bucket(spark):
    index = exact_dedup.temporary_index(spark)
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 300).cast("string").alias("text"))
    got = exact_dedup.deduplicate(docs, index)
    assert got.filter("kept").count() == 300 == index.rows().select("digest").distinct().count() == index.rows().count()
    assert got.filter("keep_id <> doc_id % 300 OR group_size NOT IN (3, 4)").count() == 0


# ---- fill-in-middle --------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="a\né😀\x0b\x8a", max_size=40), max_size=6))
def test_marks_equal_a_count_byte_by_byte(parts):
    data = "".join(parts).encode()
    words = fim.words_of(np.frombuffer(data, np.uint8))
    lines, points = fim.Marks(fim.equal_bytes(words, 10)), fim.Marks(fim.code_points(words))
    every = np.arange(len(data) + 1)
    assert lines.rank(every).tolist() == [data[:i].count(b"\n") for i in every]
    assert points.rank(every).tolist() == [sum(b & 0xC0 != 0x80 for b in data[:i]) for i in every]
    feeds = [i for i, b in enumerate(data) if b == 10]
    assert lines.select(np.arange(len(feeds))).tolist() == feeds


def test_every_byte_value_is_told_from_a_line_feed():
    data = np.arange(256, dtype=np.uint8).repeat(9)
    marks = fim.equal_bytes(fim.words_of(data), 10).view(np.uint8)[: len(data)]
    assert (marks == np.where(data == 10, 0x80, 0)).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(-5, 10**12), st.none() | st.text(alphabet="ab\né😀<PSM>", max_size=30)), max_size=8))
def test_batches_equal_texts_one_by_one(rows):
    ids, texts = [i for i, _ in rows], [t for _, t in rows]
    got = fim.transform_batch(pa.array([0, *ids], pa.int64()).slice(1), pa.array(["skipped\n", *texts], pa.string()).slice(1))
    assert list(zip(*[c.to_pylist() for c in got], strict=True)) == [plain.fim(i, t)[:5] for i, t in rows]


def test_restored_from_output_and_form(spark):
    rows = [(i, t) for i, t in enumerate(["", None, "x", "a\nb\nc", "<S>\n", "é\n" * 50, "long line " * 100_000] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit("clash"))
    made = fim.transform(docs)
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert made.filter(fim.restored(F.col("output"), F.col("form")) != F.coalesce("text", F.lit(""))).count() == 0
    assert made.filter("form <> 'plain'").count() == 12

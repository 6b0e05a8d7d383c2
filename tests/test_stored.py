"""Tables stored by key bucket, and staging in parts."""

import os
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracklens.operators import relational as rel
from tracklens.sources import parts
from tracklens.sources.keyed import KeyedTable

SHAPE = "id long, genre string, label string"


def _files(path) -> set[str]:
    return {str(f) for f in Path(path).rglob("*.parquet")}


def _rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_an_update_rewrites_only_its_buckets(spark, tmp_path):
    base = spark.createDataFrame([*[(i, f"g{i}", None if i % 4 == 0 else "l") for i in range(400)], (None, "no key", "x"), (None, "no key", "x")], SHAPE)
    path = str(tmp_path / "t")
    table = KeyedTable.create(base, path, "id", 16)
    assert _rows(table.read()) == _rows(base)
    before, old = _files(path), table.read()
    updates = spark.createDataFrame([(7, None, None), (8, "n", "n"), (8, "m", "z"), (None, "q", "q"), (9999, "nobody", "x")], SHAPE)
    policy = {"genre": "keep_non_null", "label": "overwrite"}
    touched = table.update(updates, policy)
    want = rel.apply_updates(base, updates, "id", policy)
    assert _rows(table.read()) == _rows(want) and 1 <= len(touched) <= 3
    assert before <= _files(path)
    new = _files(path) - before
    assert {f.split("bucket=")[1].split("/")[0] for f in new} == {str(b) for b in touched}
    named = table.manifest()["folders"]
    assert len({f for b, f in named.items() if int(b) not in touched}) == 1  # the folder they were made in
    assert _rows(old) == _rows(base)  # what was read before stays as it was
    assert _rows(table.lookup([8, 12345])) == [(8, "m", "z")]


def test_inserts_deletes_empty_tables_and_left_overs(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable.create(spark.createDataFrame([], SHAPE), path, "id", 4)
    assert table.read().count() == 0 and table.update(spark.createDataFrame([(1, "a", "b")], SHAPE), {"genre": "overwrite"}) == []
    table.insert(spark.createDataFrame([(1, "b", None), (1, "a", None), (2, "c", None), (None, "x", None)], SHAPE))
    table.insert(spark.createDataFrame([(2, "other", None), (3, "d", None)], SHAPE))
    assert _rows(table.read()) == [(1, "a", None), (2, "c", None), (3, "d", None)]
    table.delete(spark.createDataFrame([(1,), (2,), (77,)], "id int"))
    assert _rows(table.read()) == [(3, "d", None)]
    table.delete(spark.createDataFrame([(3,)], "id long"))
    assert table.read().count() == 0
    table.insert(spark.createDataFrame([(5, "e", None)], SHAPE))
    assert table.vacuum() and _rows(table.read()) == [(5, "e", None)] and table.vacuum() == []


def test_a_run_that_dies_and_a_second_writer_change_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    base = spark.createDataFrame([(i, "g", "l") for i in range(50)], SHAPE)
    table = KeyedTable.create(base, path, "id", 4)
    broken = spark.createDataFrame([(1, "n", "n")], SHAPE)
    from tracklens.sources import keyed

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(keyed, "mark", dies)
        with pytest.raises(OSError):
            table.update(broken, {"genre": "overwrite"})
    assert _rows(table.read()) == _rows(base)
    with monkeypatch.context() as m:
        m.setattr(table, "_last", lambda: -1)  # a writer that has not seen the version that is there
        m.setattr(table, "manifest", KeyedTable(spark, path).manifest)
        with pytest.raises(FileExistsError):
            table.update(broken, {"genre": "overwrite"})
    assert _rows(table.read()) == _rows(base)
    table.update(broken, {"genre": "overwrite"})
    assert table.read().filter("genre = 'n'").count() == 1


def test_staging_goes_on_with_missing_parts_and_notices_changes(spark, tmp_path):
    source, path, other = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "other")
    spark.range(300).repartition(9).write.parquet(source)
    spark.range(3).coalesce(1).write.parquet(other)
    made: list[int] = []

    def build(files, fail_at=None):
        if fail_at is not None and len(made) == fail_at:
            raise OSError("lost")
        made.append(len(files))
        return spark.read.parquet(*files).filter("id % 2 = 0")

    run = lambda fail_at=None, **more: parts.stage_parts(spark, source, path, lambda f: build(f, fail_at), 4, **more)
    even = [(i,) for i in range(0, 300, 2)]
    with pytest.raises(OSError):
        run(fail_at=2)
    assert len(made) == 2
    made.clear()
    assert sorted(map(tuple, run().collect())) == even
    total = len(made) + 2
    made.clear()
    assert run().count() == 150 and made == []
    changed = random.Random(1).choice(sorted(Path(source).glob("*.parquet")))
    os.utime(changed, (time.time() + 50, time.time() + 50))
    assert run().count() == 150 and len(made) == 1
    made.clear()
    spark.createDataFrame([(1000,)], "id long").coalesce(1).write.mode("append").parquet(source)
    assert run().count() == 151 and len(made) == 1
    made.clear()
    assert run(version="2").count() == 151 and len(made) >= total
    made.clear()
    run(version="2", others=(other,))
    made.clear()
    assert run(version="2", others=(other,)).count() == 151 and made == []
    spark.range(1).coalesce(1).write.mode("append").parquet(other)
    run(version="2", others=(other,))
    assert len(made) >= total
    os.makedirs(str(tmp_path / "nothing"))
    with pytest.raises(FileNotFoundError):
        parts.stage_parts(spark, str(tmp_path / "nothing"), path, build)

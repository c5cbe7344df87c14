"""Stored tables: what a failed run leaves, reruns, two writers, and what vacuum removes."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources.stored import Conflict, Stored

ROWS = [(1, "a", 1.0, 1), (2, "a", 2.0, 1), (3, "b/x", 3.0, 1), (4, None, 4.0, 1), (5, "c", 5.0, 1)]
SCHEMA = "k long, part string, v double, at int"


@pytest.fixture
def stored(spark, tmp_path):
    t = Stored(spark, f"file://{tmp_path}/t", ["part"])
    t.replace_parts(spark.createDataFrame(ROWS, SCHEMA), run="first")
    return t


def rows(t, **args):
    return sorted(map(tuple, t.read(**args).collect()))


def files(tmp_path):
    return sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.parquet"))


def failing(spark, rows_):
    @F.udf("double")
    def bad(k, v):
        if k == 31:
            raise ValueError("a task fails")
        return v

    return spark.createDataFrame(rows_, SCHEMA).repartition(3).withColumn("v", bad("k", "v"))


def test_parts_are_replaced(spark, stored):
    assert rows(stored) == sorted(ROWS, key=lambda r: r[0])
    stored.replace_parts(spark.createDataFrame([(9, "a", 9.0, 2), (8, "new", 8.0, 2)], SCHEMA), run="second")
    assert rows(stored) == [(3, "b/x", 3.0, 1), (4, None, 4.0, 1), (5, "c", 5.0, 1), (8, "new", 8.0, 2), (9, "a", 9.0, 2)]
    assert rows(stored, number=1) == sorted(ROWS, key=lambda r: r[0])
    stored.replace_parts(spark.createDataFrame([], SCHEMA), emptied=["part=c"])
    assert [r[0] for r in rows(stored)] == [3, 4, 8, 9]
    stored.replace_parts(spark.createDataFrame([(7, "z", 7.0, 3)], SCHEMA), all_parts=True)
    assert rows(stored) == [(7, "z", 7.0, 3)]


def test_a_failed_run_leaves_the_old_state_and_a_rerun_mends_it(spark, stored, tmp_path):
    new = [(30, "a", 0.0, 2), (31, "c", 0.0, 2), (32, "d", 0.0, 2)]
    with pytest.raises(Exception, match="a task fails"):
        stored.replace_parts(failing(spark, new), run="second")
    assert rows(stored) == sorted(ROWS, key=lambda r: r[0]) and stored.manifest()["number"] == 1
    good = spark.createDataFrame(new, SCHEMA)
    stored.replace_parts(good, run="second")
    want, before = rows(stored), files(tmp_path)
    assert [r[0] for r in want] == [3, 4, 30, 31, 32]
    assert stored.replace_parts(good, run="second") == 2 and rows(stored) == want and files(tmp_path) == before


def test_a_run_that_dies_before_the_switch_is_not_seen(spark, stored, tmp_path, monkeypatch):
    new = spark.createDataFrame([(30, "a", 0.0, 2)], SCHEMA)
    monkeypatch.setattr(Stored, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        stored.replace_parts(new, run="second")
    monkeypatch.undo()
    assert rows(stored) == sorted(ROWS, key=lambda r: r[0]) and any("run_=second" in f for f in files(tmp_path))
    stored.replace_parts(new, run="second")
    assert [r[0] for r in rows(stored)] == [3, 4, 5, 30] and sum("run_=second" in f for f in files(tmp_path)) == 1


def test_two_writers(spark, stored):
    other = Stored(spark, stored.path, ["part"])
    before = stored.manifest()
    other.replace_parts(spark.createDataFrame([(6, "a", 6.0, 2)], SCHEMA), run="other")
    stored.manifest = lambda number=None: before
    with pytest.raises(Conflict):
        stored.replace_parts(spark.createDataFrame([(7, "a", 7.0, 2)], SCHEMA), run="mine")
    del stored.manifest
    assert [r[0] for r in rows(stored)] == [3, 4, 5, 6]


def test_upsert_touches_only_its_parts(spark, stored, tmp_path):
    before = {f for f in files(tmp_path) if "part=c" in f or "part=b" in f}
    new = spark.createDataFrame([(2, "a", 20.0, 2), (1, "a", 10.0, 0), (6, "a", 60.0, 2), (4, None, 40.0, 2), (11, "n", 1.0, 1), (11, "n", 2.0, 2)], SCHEMA)
    stored.upsert(new, ["k"], ["at"], run="u")
    want = [(1, "a", 1.0, 1), (2, "a", 20.0, 2), (3, "b/x", 3.0, 1), (4, None, 40.0, 2), (5, "c", 5.0, 1), (6, "a", 60.0, 2), (11, "n", 2.0, 2)]
    assert rows(stored) == want and before <= set(files(tmp_path)) and not any("run_=u" in f for f in files(tmp_path) if "part=c" in f)
    assert stored.upsert(new, ["k"], ["at"], run="u") == 2


def test_vacuum(spark, stored, tmp_path):
    stored.replace_parts(spark.createDataFrame([(9, "a", 9.0, 2)], SCHEMA), run="second")
    want = rows(stored)
    assert stored.vacuum() == 1 and rows(stored) == want and not any("part=a/run_=first" in f for f in files(tmp_path))
    assert stored.vacuum() == 0 and stored.manifest()["number"] == 2
    assert Stored(spark, f"file://{tmp_path}/none", ["part"]).read() is None

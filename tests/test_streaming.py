"""Captures of a stream that comes out of order: what the table gives, windows without a later sample, and state that goes."""

import random

import pytest

from tidemark.streaming import debounce

RULES = {"trigger": 50, "reset": 25, "length": 60, "idle": 200, "forget": 3000}


def samples(seed, keys=5, n=120):
    rng = random.Random(seed)
    return [(k, t * 17 + rng.randrange(15), float(rng.choice([5, 20, 30, 55, 60, 80]))) for k in range(keys) for t in sorted(rng.sample(range(2000), n))]


def run(spark, tmp_path, files, delay, **rules):
    """The files one batch each; (captures, rows of state at the end)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    import os

    for n, rows in enumerate(files):
        spark.createDataFrame(rows, "key long, ms long, value double").coalesce(1).write.parquet(str(tmp_path / f"b{n}"))
        (part,) = [f for f in os.listdir(tmp_path / f"b{n}") if f.startswith("part-")]
        os.makedirs(tmp_path / "in", exist_ok=True)
        os.rename(tmp_path / f"b{n}" / part, tmp_path / "in" / f"{n:03d}.parquet")
        os.utime(tmp_path / "in" / f"{n:03d}.parquet", (n + 1, n + 1))
    stream = spark.readStream.schema("key long, ms long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = debounce.stream_captures(stream, delay=delay, **rules).writeStream.format("memory").queryName("got").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        q.awaitTermination(240)
        assert q.exception() is None
        state = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress["stateOperators"] else 0
        return sorted(map(tuple, spark.table("got").collect())), state
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_out_of_order_within_the_watermark(spark, tmp_path):
    rows, rng = samples(1), random.Random(2)
    late = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 900))  # up to 0.9 s late
    files = [late[i : i + 150] for i in range(0, len(late), 150)]
    got, state = run(spark, tmp_path, [*files, [(99, 10**9, 0.0)]], "1 second", **RULES)
    want = sorted(map(tuple, debounce.captures(spark.createDataFrame(rows, "key long, ms long, value double"), "key", "ms", "value", **RULES).collect()))
    assert got == want and len(want) > 50
    assert state <= 8  # of the one key whose sample is still waiting


def test_a_window_without_a_later_sample_is_closed(spark, tmp_path):
    files = [[(1, 1000, 70.0), (1, 1010, 90.0), (2, 1000, 60.0)], [(3, 500_000, 1.0)], [(3, 900_000, 1.0)]]
    assert run(spark, tmp_path, files, "1 second", **RULES)[0] == [(1, 1000, 90.0, 2), (2, 1000, 60.0, 1)]
    table = spark.createDataFrame([r for f in files for r in f], "key long, ms long, value double")
    assert sorted(map(tuple, debounce.captures(table, "key", "ms", "value", **RULES).collect())) == [(1, 1000, 90.0, 2), (2, 1000, 60.0, 1)]
    assert debounce.captures(table, "key", "ms", "value", 50, 25, 60).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_rules(seed):
    """State by state: a capture is given out once, and what is due is never before now."""
    rules, state, out, last = debounce.Rules(**RULES), debounce.State(), [], 0
    for _, ms, value in (r for r in samples(seed) if r[0] == 0):
        due = debounce.next_due(state, rules)
        assert due is None or due > last
        if due is not None and ms > due:
            assert debounce.overdue(state, due, rules)[0] != state and debounce.overdue(state, due - 1, rules)[0] == state
        state, done = debounce.advance(state, ms, value, rules)
        out += done
        last = ms
    assert len({d[0] for d in out}) == len(out)

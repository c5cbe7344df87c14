"""Known answers, and properties that must hold whatever the data."""

import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import sequence as Q
from tidemark.functions import special, text
from tidemark.operators import calendar, factors, order, panel, relational, simulate, stats
from tidemark.sources import delimited, files, rules
from tidemark.streaming import debounce


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_gaps_are_not_bridged(spark):
    p = spark.createDataFrame([(1, i, x) for i, x in enumerate((100.0, None, 121.0, 133.1))], "security_id long, week int, price double")
    got = [r["log_return"] for r in panel.adjacent_log_return(p).orderBy("week").collect()]
    assert got[:3] == [None, None, None] and got[3] == pytest.approx(math.log(133.1 / 121))


@pytest.mark.parametrize(("symbol", "currency"), [("2330.TW", "TWD"), ("005930.KS", "KRW"), ("0700.HK", "HKD"), ("HSBA.L", "GBp"), ("AAPL", "USD"), ("NBK.KW", "KWD")])
def test_listing_currency(spark, symbol, currency):
    assert one(spark, text.listing_currency(F.lit(symbol), F.lit("US")))["code"] == currency


@pytest.mark.parametrize(("given_", "want"), [("GBp", ("GBP", 0.01)), ("GBX", ("GBP", 0.01)), ("GBP", ("GBP", 1.0)), ("ZAc", ("ZAR", 0.01)), ("ILA", ("ILS", 0.01)), ("KWF", ("KWD", 0.001)), ("USc", ("USD", 0.01)), ("eur", ("EUR", 1.0))])
def test_currency_units(spark, given_, want):
    assert tuple(one(spark, text.currency(F.lit(given_)))) == want


def test_expanding_folds():
    bounds = calendar.fold_bounds(420, 3, 180)
    assert bounds == [(0, 180, 260), (1, 260, 340), (2, 340, 420)]


@given(st.integers(50, 500), st.integers(1, 6), st.integers(10, 49))
def test_folds_never_leak(rows, folds, least):
    bounds = calendar.fold_bounds(rows, folds, least)
    assert all(a < b for _, a, b in bounds) and bounds[-1][2] == rows
    assert all(x[2] == y[1] for x, y in zip(bounds, bounds[1:], strict=False))


def test_protein(spark):
    rna = Q.from_start(Q.to_rna(F.lit("GAGCAGCTCTACATGGACCAGTTTCAGCTTTAAAAGCACAAA")))
    assert one(spark, Q.protein(rna)) == "MDQFQL"
    assert one(spark, Q.short_names(rna)) == "Met-Asp-Gln-Phe-Gln-Leu"
    assert one(spark, Q.from_start(F.lit("CCC"))) is None


@pytest.mark.parametrize(("peptide", "ways"), [("MA", 4), ("MASS", 144), ("VKLFPWFNQY", 6144)])
def test_encodings(spark, peptide, ways):
    assert one(spark, Q.encodings(F.lit(peptide))) == ways


def test_bits(spark):
    assert one(spark, Q.from_bits(F.array(*map(F.lit, (1, 0, 1))), 0, 3)) == 5
    assert one(spark, Q.to_bits(F.lit(20), 5)) == [1, 0, 1, 0, 0]
    assert one(spark, Q.to_bits(F.lit(5), 5)) == [0, 0, 1, 0, 1]


def test_crps_of_a_point(spark):
    s = spark.createDataFrame([(1, 3.0, 5.5)] * 4, "g int, x double, y double")
    assert order.crps(s, ["g"], "x", "y").first()["crps"] == pytest.approx(2.5)


@pytest.mark.parametrize(("values", "block"), [([0.5] * 40, 2), ([1.0, 9.0, 2.0], 2), ([float(i) for i in range(11)], 2), ([float(i // 8) for i in range(80)], 20), ([], 2)])
def test_block_length_of_flat_and_short_series(spark, values, block):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos int, x double")
    assert stats.block_length(stats.autocorrelation(df, "pos", "x", 26)).first()["block"] == block


def test_mean_and_error(spark):
    s = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 7.0), (3, None)], "g int, x double")
    got = {r["g"]: (r["mean"], r["error"]) for r in stats.mean_and_error(s, ["g"], "x").collect()}
    assert got[1] == (3.0, pytest.approx(1.0)) and got[2] == (7.0, 0.0) and got[3] == (None, None)


def test_walks_spread_as_they_should(spark):
    w = simulate.walk_1d(spark, 2000, 64).filter("step = 64").agg(F.avg(F.col("x") * F.col("x"))).first()[0]
    assert w == pytest.approx(64, rel=0.15)
    w = simulate.walk_2d(spark, 2000, 64, "grid8").filter("step = 64").agg(F.avg(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).first()[0]
    assert w == pytest.approx(4 * 64 / 3, rel=0.15)


def test_ruin_is_fair(spark):
    g = simulate.ruin(spark, 2000, 600, 4, 8, 0.5).agg(F.avg((~F.col("first_won")).cast("double")), F.avg("steps")).first()
    assert g[0] == pytest.approx(8 / 12, abs=0.04) and g[1] == pytest.approx(32, rel=0.12)


def test_box_walks_stay_inside(spark):
    b = simulate.box_walk(spark, 50, 300, 2.0, 1.5)
    assert b.filter((F.abs("x") >= 2.0) | (F.abs("y") >= 1.5)).count() == 0
    t = simulate.target_walk(spark, 50, 300, 3.0, (1.0, 1.0, 1.0, 1.0))
    assert t.filter("hit").count() > 0 and t.filter("moves > 300").count() == 0


def test_wrapped_angles(spark):
    wrap = lambda a: a - 360 * math.ceil((a - 180) / 360)
    assert [wrap(a) for a in (190, -180, 180)] == [-170, 180, 180]


def test_null_and_empty_tables(spark):
    empty = spark.createDataFrame([], "k long, v double, t long")
    assert relational.last_per_key(empty, ["k"], ["t"]).count() == 0
    assert stats.mean_and_error(empty, ["k"], "v").count() == 0
    assert debounce.captures(empty, "k", "t", "v").count() == 0
    nulls = spark.createDataFrame([(None, 1.0, 1), (None, 2.0, 2)], "k long, v double, t long")
    assert [tuple(r) for r in relational.last_per_key(nulls, ["k"], ["t"]).collect()] == [(None, 2.0, 2)]


def test_low_rank_cells_are_found_again():
    rng = np.random.default_rng(1)
    full = rng.standard_normal((60, 2)) @ rng.standard_normal((2, 12))
    holes = np.where(rng.random(full.shape) < 0.05, np.nan, full)
    got = factors.impute(holes, 2, rounds=500)
    assert np.abs(got - full).max() < 1e-3
    components, singular, share = factors.axes(got, 2)
    assert share.sum() == pytest.approx(1, abs=0.05) and singular[0] >= singular[1]
    assert np.allclose(components @ components.T, np.eye(2), atol=1e-8)
    assert factors.masked_scores(np.full(12, np.nan), components) is None


def test_model_of_a_wide_sparse_panel(spark):
    """Gram matrices over tasks give what one matrix gives: imputation, axes, scores, residuals and the basket."""
    import datetime

    rng = np.random.default_rng(4)
    x = rng.standard_normal((40, 2)) @ rng.standard_normal((2, 70)) + 0.1 * rng.standard_normal((40, 70))
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 3] = np.nan
    weeks = [datetime.date(2000, 1, 7) + datetime.timedelta(7 * i) for i in range(40)]
    cells = [(weeks[i], int(k), float(x[i, k])) for i in range(40) for k in range(70) if np.isfinite(x[i, k])]
    df = spark.createDataFrame(cells, "week date, key long, x double").repartition(5)
    model = factors.fit(factors.Panel(df), 2, 30)
    keep = np.isfinite(x[:30]).sum(axis=0) >= 2
    z, mean, scale = factors.standardise(x[:, keep], np.arange(40) < 30)
    full, ok = np.where(np.isfinite(z[:30]), z[:30], 0.0), np.isfinite(z[:30])
    for _ in range(4):
        u, s, vt = np.linalg.svd(full, full_matrices=False)
        full = np.where(ok, z[:30], (u[:, :2] * s[:2]) @ vt[:2])
    components, singular, _ = factors.axes(full, 2)
    got = {r["key"]: r for r in model["loadings"].collect()}
    assert sorted(got) == np.flatnonzero(keep).tolist() and np.allclose(model["singular"], singular)
    assert np.allclose(np.array([got[k]["loading"] for k in sorted(got)]).T, components)
    sc = factors.scores(df, model, least=0.0)
    by = {(r["week"], r["factor"]): r["score"] for r in sc.collect()}
    want = np.array([factors.masked_scores(row, components, ridge=1e-4, least=0.0) for row in z])
    assert np.allclose([[by[w, 1], by[w, 2]] for w in weeks], want)
    rest = np.where(ok, z[:30] - want[:30] @ components, np.nan)
    scales = {r["key"]: r["residual_scale"] for r in factors.residual_scales(df, model, sc, weeks[29]).collect()}
    assert np.allclose([scales[k] for k in sorted(got)], np.nanstd(rest, axis=0, ddof=1))
    base, loadings = factors.projection(model)
    assert base == pytest.approx(mean.mean()) and np.allclose(loadings, (scale * components).mean(axis=1))
    few = factors.scores(df.filter("key < 5"), model).collect()
    assert all(r["score"] is None for r in few)  # less than half of the keys


def test_forecast_error():
    """An autoregression of known coefficients is forecast nearly as well as its noise allows; missing weeks give no error."""
    rng = np.random.default_rng(6)
    x = np.zeros((400, 2))
    for t in range(1, 400):
        x[t] = 0.8 * x[t - 1] + 0.1 * rng.standard_normal(2)
    got = factors.forecast_error(x[:300], x[300:])
    best = ((x[300:] - 0.8 * x[299:-1]) ** 2 / x[:300].var(axis=0, ddof=1)).mean()
    assert best * 0.9 < got < best * 1.15
    holes = x[300:].copy()
    holes[10] = np.nan
    assert np.isfinite(factors.forecast_error(x[:300], holes)) and np.isnan(factors.forecast_error(x[:4], holes)) and np.isnan(factors.forecast_error(x[:300], np.full((5, 2), np.nan)))


def test_var_is_stable():
    rng = np.random.default_rng(2)
    v = factors.stable_var(np.cumsum(rng.standard_normal((200, 3)), axis=0), 2)
    assert v["radius"] <= 0.98 and np.linalg.eigvalsh(v["covariance"]).min() > 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.floats(0, 100)), max_size=60))
def test_captures_are_apart(steps):
    state, ms, done = debounce.State(), 0, []
    for gap, v in steps:
        ms += gap
        state, got = debounce.advance(state, ms, v, debounce.Rules(50, 25, 60))
        done += got
    assert all(b[0] - a[0] >= 60 for a, b in zip(done, done[1:], strict=False)) and all(peak > 50 for _, peak, _ in done)


def test_stream_gives_what_the_batch_gives(spark, sf_dir, tmp_path):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "value")
    later = spark.createDataFrame([(-1, 1 << 42, 0.0)], ev.schema)  # moves the watermark past all others
    ev.unionByName(later).repartition(1).sortWithinPartitions("ms").write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batch = sorted(map(tuple, debounce.captures(ev, "key", "ms", "value", 100, 25, 3_600_000).collect()))
    stream = debounce.stream_captures(spark.readStream.schema("key long, ms long, value double").parquet(str(tmp_path / "in")), 100, 25, 3_600_000)
    q = stream.writeStream.format("memory").queryName("captures").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(map(tuple, spark.table("captures").collect())) == batch


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    files.write_parquet(df, str(tmp_path / "p"))
    assert sorted(map(tuple, files.read_parquet(spark, str(tmp_path / "p")).collect()), key=str) == [(1, "a"), (2, None)]
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv_text(spark, str(tmp_path / "c"), ["k", "v"]).collect())) == [("1", "a"), ("2", "")]
    assert files.write_json_report({"b": 1, "a": 2}, str(tmp_path / "r.json")).index('"a"') < 10
    assert files.read_json_report(str(tmp_path / "r.json")) == {"a": 2, "b": 1}


def test_delimited_text_of_unknown_make(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("report of today\nTicker;Weight;Ticker\nFoo;1;x\n\nBar;2\nTicker;Weight;Ticker\nBaz;3;y;z\n".encode("utf-16"))
    got = delimited.read_delimited(spark, str(tmp_path / "a.txt")).orderBy("row", "name").collect()
    assert [(r["row"], r["name"], r["value"]) for r in got] == [
        (0, "Ticker", "Foo"), (0, "Ticker_2", "x"), (0, "Weight", "1"), (1, "Ticker", "Bar"), (1, "Ticker_2", ""), (1, "Weight", "2"), (2, "Ticker", "Baz"), (2, "Ticker_2", "y"), (2, "Weight", "3"),
    ]


@pytest.mark.parametrize(("header", "score"), [("Ticker,Holdings,% of fund", 23), ("a,b", -1), ("a,b,c", 0), ("Name,Market value,Shares", 8), ("SEDOL,ISIN,CUSIP,Weight", 8), ("Symbol,Security name,Weight (%)", 23)])
def test_header_score(header, score):
    assert rules.header_score(header.split(",")) == score


def test_special_functions(spark):
    assert one(spark, special.log_sum_exp(F.array(F.lit(1000.0), F.lit(1000.0)))) == pytest.approx(1000 + math.log(2))
    assert one(spark, special.log_gamma(F.lit(4.5))) == pytest.approx(math.lgamma(4.5))
    assert one(spark, special.name_similarity(F.lit("Foo Inc"), F.lit("foo corp"))) == 1.0


def test_entry_without_the_optional_parts(tmp_path):
    """With the optional folders and the pipeline deleted the entry still imports, and has all other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    import __spark_entry__

    root, copy = Path(__file__).resolve().parents[1], tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"
    got = subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr[-2000:]
    whole, rest = set(__spark_entry__.queries()), set(got.stdout.split())
    assert len(rest) > 150 and {q for q in whole - rest if q != "pipeline" and not re.match(r"op\d+_", q)} == set() and rest <= whole
    assert "corpus_pipeline" not in got.stdout and not any(re.match(r"op\d+_", q) for q in rest)

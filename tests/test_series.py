from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from loadspark.operators.fills import backward_fill, fill_both, forward_fill
from loadspark.operators.quantiles import group_quantile
from loadspark.operators.reshape import every_nth
from loadspark.operators.rolling import (
    Roll,
    _roll_block,
    _with_halo,
    add_lag,
    add_persistence,
    broadcast_bucket_mean,
    roll_indexed,
    rolling,
    rolling_many,
    transitions,
)
import loadspark.series
from loadspark.series import (
    BUCKET,
    SeriesSpec,
    attach_stats,
    floor_to,
    resample,
    rows_at,
    step_start,
    with_blocks,
    with_row_index,
)
from tests.helpers import BASE, assert_column, plan, rows, series

KEYED = SeriesSpec("ts", ("k",), bucket_rows=96)
PLAIN = SeriesSpec("ts", ("k",), bucket_rows=None)
GLOBAL = SeriesSpec("ts", (), bucket_rows=96)


@pytest.fixture(scope="module")
def data(spark):
    df, pdf = series(spark)
    return df.cache(), pdf


@pytest.mark.parametrize("spec", [KEYED, PLAIN])
def test_fills_equal_pandas(data, spec):
    df, pdf = data
    x = pdf.groupby("k")["x"]
    assert_column(forward_fill(df, spec, ["x"]), "x", x.ffill())
    assert_column(backward_fill(df, spec, ["x"]), "x", x.bfill())
    assert_column(fill_both(df, spec, ["x"]), "x", x.bfill().groupby(pdf["k"]).ffill())
    assert_column(fill_both(df, spec, ["x"], "forward"), "x", x.ffill().groupby(pdf["k"]).bfill())


def test_fill_of_one_global_series(data):
    df, pdf = data
    one = pdf[pdf.k == 1]
    assert_column(forward_fill(df.where("k = 1"), GLOBAL, ["x"]), "x", one.x.ffill(), ["ts"])


def test_fill_crosses_empty_buckets(spark):
    day = [("2024-01-01 00:00:00", None), ("2024-01-01 00:15:00", 5.0), ("2024-03-01 00:00:00", None)]
    day += [("2024-05-01 00:00:00", 7.0), ("2024-05-01 00:15:00", None)]
    df = rows(spark, day, "ts string, x double", "ts")
    got = [r.x for r in forward_fill(df, GLOBAL, ["x"]).orderBy("ts").collect()]
    assert got == [None, 5.0, 5.0, 7.0, 7.0]
    got = [r.x for r in backward_fill(df, GLOBAL, ["x"]).orderBy("ts").collect()]
    assert got == [5.0, 5.0, 7.0, 7.0, None]
    near = forward_fill(df, GLOBAL, ["x"], timedelta(hours=1))
    assert [r.x for r in near.orderBy("ts").collect()] == [None, 5.0, None, 7.0, 7.0]


def test_fill_keeps_column_order_and_other_types(spark):
    df = rows(spark, [("2024-01-01", "a", True), ("2024-01-02", None, None)], "ts string, s string, b boolean", "ts")
    out = forward_fill(df, GLOBAL, ["s", "b"])
    assert out.columns == df.columns
    assert out.orderBy("ts").collect()[1][1:] == ("a", True)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=40), bucket=st.integers(1, 200))
def test_fill_property(spark, values, bucket):
    base = pd.Timestamp("2024-01-01")
    data = [(str(base + pd.Timedelta(minutes=15 * 20 * i)), None if v is None else float(v)) for i, v in enumerate(values)]
    df = rows(spark, data, "ts string, x double", "ts")
    out = forward_fill(df, SeriesSpec("ts", (), bucket_rows=bucket), ["x"])
    expected = pd.Series(values, dtype="float64").ffill()
    assert_column(out, "x", expected, ["ts"])


def test_row_index_with_ties(spark):
    data = [("2024-01-01", 2), ("2024-01-01", 1), ("2023-01-01", 9), (None, 7)]
    df = rows(spark, data, "ts string, id int", "ts")
    out = with_row_index(df, SeriesSpec("ts", (), bucket_rows=4, tie=("id",)))
    assert {r.id: r.row_idx for r in out.collect()} == {9: 0, 1: 1, 2: 2, 7: None}


@pytest.mark.parametrize("spec", [KEYED, PLAIN])
def test_rolling_equals_pandas(data, spec):
    df, pdf = data
    x = pdf.groupby("k")["x"]
    assert_column(rolling(df, spec, "x", 20, min_samples=3, out="r"), "r", x.transform(lambda s: s.rolling(20, 3).mean()))
    assert_column(rolling(df, spec, "x", 4, out="r"), "r", x.transform(lambda s: s.rolling(4).mean()))
    two = [Roll("x", "med", "median"), Roll("x", "p90", "quantile", 0.9)]
    out = rolling_many(df, spec, two, 50, 5)
    assert_column(out, "med", x.transform(lambda s: s.rolling(50, 5).median()))
    assert_column(out, "p90", x.transform(lambda s: s.rolling(50, 5).quantile(0.9)))
    shifted = rolling(df, spec, "x", 30, min_samples=1, out="r", shift=2)
    assert_column(shifted, "r", x.transform(lambda s: s.shift(2).rolling(30, 1).mean()))


def test_long_mean_window(data):
    df, pdf = data
    out = rolling(df, KEYED, "x", 300, "std", min_samples=2, out="r")
    assert_column(out, "r", pdf.groupby("k")["x"].transform(lambda s: s.rolling(300, 2).std()), atol=1e-7)


@pytest.mark.parametrize("spec", [KEYED, PLAIN])
@pytest.mark.parametrize("mode", ["rows", "time"])
def test_lag(data, spec, mode):
    df, pdf = data
    assert_column(add_lag(df, spec, "x", 97, mode), "x_lag", pdf.groupby("k")["x"].shift(97))


def test_persistence_modes_differ_on_gaps(spark):
    data = [(f"2024-01-{d:02d} 00:00:00", float(d)) for d in range(1, 12) if d != 5]
    df = rows(spark, data, "ts string, load double", "ts")
    spec = SeriesSpec("ts", (), timedelta(days=1))
    by_time = {r.ts.day: r.load_persistence_7d for r in add_persistence(df, spec).collect()}
    by_rows = {r.ts.day: r.load_persistence_7d for r in add_persistence(df, spec, mode="rows").collect()}
    assert by_time[8] == 1.0 and by_time[11] == 4.0
    assert by_rows[8] is None and by_rows[9] == 1.0


def test_transitions(spark):
    data = [(f"2024-01-{d:02d}", f) for d, f in enumerate([True, True, False, None, True, False], 1)]
    df = rows(spark, data, "ts string, f boolean", "ts")
    assert [r.ts.day for r in transitions(df, GLOBAL, "f").orderBy("ts").collect()] == [3, 6]


def test_every_nth(data):
    df, pdf = data
    want = pdf[pdf.k == 0].iloc[::7].head(5)
    got = every_nth(df.where("k = 0"), GLOBAL, 7, 5).orderBy("ts").toPandas()
    assert list(got.ts) == list(want.ts)


def test_hour_mean_starts_at_quarter_past(spark):
    quarter = [f"2024-01-01 00:{m:02d}:00" for m in (0, 15, 30, 45)] + ["2024-01-01 01:00:00"]
    df = rows(spark, [(t, float(i)) for i, t in enumerate(quarter)], "ts string, y double", "ts")
    out = broadcast_bucket_mean(df, GLOBAL, "y").orderBy("ts").collect()
    assert [r.y_hourly for r in out] == [0.0, 2.5, 2.5, 2.5, 2.5]


def test_resample_completes_the_grid(spark):
    data = [(1, "2024-01-01 10:07:00", 1.0), (1, "2024-01-01 10:08:00", 3.0), (2, "2024-01-02 23:59:59", 5.0), (3, None, 1.0)]
    df = rows(spark, data, "k int, ts string, v double", "ts")
    spec = SeriesSpec("ts", ("k",))
    out = resample(df, spec, {"m": F.avg("v"), "n": F.count("v")})
    assert out.count() == 2 * 2 * 96
    known = {(r.k, str(r.ts)): (r.m, r.n) for r in out.where("m is not null").collect()}
    assert known == {(1, "2024-01-01 10:00:00"): (2.0, 2), (2, "2024-01-02 23:45:00"): (5.0, 1)}
    tight = resample(df, SeriesSpec("ts"), {"m": F.avg("v")}, whole_days=False)
    assert tight.count() == 4 * 14 + 96
    assert resample(df, spec, {"m": F.avg("v")}, complete=False).count() == 2


def test_step_start_agrees_with_floor(spark):
    df = rows(spark, [("2024-02-29 23:59:59",), ("1969-12-31 23:50:00",)], "ts string", "ts")
    for step, offset in ((15, 0), (60, 15)):
        a, b = timedelta(minutes=step), timedelta(minutes=offset)
        out = df.withColumn("s", step_start("ts", a, b)).withColumn("f", floor_to(F.col("ts"), a, b))
        assert all(r.s == r.f for r in out.collect())


def test_stats_per_key_reach_every_row(data):
    df, pdf = data
    out = attach_stats(df, KEYED, {"top": F.max("x")})
    assert_column(out, "top", pdf.groupby("k")["x"].transform("max"))


def test_long_series_never_enter_one_task(data):
    """Only the bucket table is gathered; rows are exchanged by key and bucket."""
    df, _ = data
    text = plan(forward_fill(df.drop("k"), GLOBAL, ["x"]))
    final = text[text.index("== Physical Plan ==") :]
    single = [line for line in final.splitlines() if "SinglePartition" in line]
    assert single and all("Exchange" in line for line in single)
    before = final[: final.index("SinglePartition")]
    assert "hashpartitioning(_bucket" in before or "hashpartitioning(_bucket" in final


def test_hot_key_is_cut_into_small_groups(spark):
    """One key with almost all rows: no bucket or block is larger than the spec allows, halo included."""
    hot, _ = series(spark, n=2000, keys=1)
    cold, _ = series(spark, n=5, keys=3)
    both = hot.unionByName(cold.where("k > 0"))
    largest = both.groupBy("k", KEYED.bucket().alias("b")).count().agg(F.max("count")).head()[0]
    assert largest <= KEYED.bucket_rows
    reach = 20
    blocks = _with_halo(with_row_index(both, KEYED, "_idx"), KEYED, reach)
    size = max(4 * reach, KEYED.bucket_rows)
    assert blocks.groupBy("k", "_block").count().agg(F.max("count")).head()[0] <= size + reach
    assert blocks.where("_owner = _block").count() == both.count()


def test_rolling_treats_nan_and_infinity_as_missing_at_any_length(spark):
    values = [float(i % 7) for i in range(400)]
    values[3], values[4], values[5] = float("nan"), None, float("inf")
    df = rows(spark, [(f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", v) for i, v in enumerate(values)], "ts string, x double", "ts")
    spec = SeriesSpec(ts="ts", step=timedelta(minutes=1))
    for n in (24, 256, 257, 300):
        got = rolling(df, spec, "x", n, min_samples=1, out="m").orderBy("ts").collect()
        for i in (2, 5, 23, 255, 256, 299, 399):
            known = [v for v in values[max(0, i - n + 1) : i + 1] if v is not None and v == v and v != float("inf")]
            assert abs(got[i]["m"] - sum(known) / len(known)) < 1e-9, (n, i)


def test_rows_without_an_instant_stay_out_of_unbucketed_frames(spark):
    df = rows(spark, [(None, 100.0), ("2024-01-01 00:00:00", 1.0), ("2024-01-01 00:15:00", 3.0)], "ts string, x double", "ts")
    spec = SeriesSpec(ts="ts", bucket_rows=None)
    out = add_lag(rolling(df, spec, "x", 2, min_samples=1, out="m"), spec, "x", 1, mode="rows", out="l")
    assert {(r["x"], r["m"], r["l"]) for r in out.collect()} == {(100.0, None, None), (1.0, 1.0, None), (3.0, 2.0, 1.0)}


def test_a_null_group_keeps_its_quantile(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, x double")
    assert {(r["g"], r["quantile"]) for r in group_quantile(df, ["g"], "x").collect()} == {(None, 2.0), ("a", 5.0)}


def test_a_grid_step_must_divide_a_day(spark):



    df = rows(spark, [("2024-01-01 00:00:00", 1.0)], "ts string, x double", "ts")
    for step in (timedelta(hours=7), timedelta(days=2)):
        with pytest.raises(ValueError, match="divides a day"):
            resample(df, SeriesSpec(ts="ts", step=step), {"x": F.sum("x")})


@pytest.mark.parametrize("fn", ["mean", "median"])
@pytest.mark.parametrize("n", [24, 256, 257, 300])
def test_rows_that_share_an_instant_keep_their_own_values(spark, n, fn):
    """Whatever the window length and the other columns, rows of one instant come in the order of their values."""
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 1500), "h": rng.integers(0, 90, 1500), "x": rng.integers(0, 40, 1500) / 4.0})
    pdf["ts"] = BASE + pd.to_timedelta(pdf["h"], "h")
    spec = SeriesSpec("ts", ("k",), timedelta(hours=1), 48)
    pdf = pdf.sort_values(["k", "ts", "x"], kind="stable").reset_index(drop=True)
    pdf["want"] = pdf.groupby("k")["x"].transform(lambda x: getattr(x.rolling(n, min_periods=1), fn)())
    want = sorted(zip(pdf["k"], pdf["h"], pdf["x"], pdf["want"].round(9), strict=True))
    df = spark.createDataFrame(pdf[["k", "h", "ts", "x"]].sample(frac=1, random_state=1))
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for other in ("none", "label"):
        wide = df if other == "none" else df.withColumn(other, F.rand(3))
        got = rolling(wide, spec, "x", n, fn, min_samples=1, out="got").collect()
        assert sorted((r["k"], r["h"], r["x"], round(r["got"], 9)) for r in got) == want


def test_copies_of_a_row_each_get_a_value(spark):
    df = rows(spark, [("2024-01-01", 1.0, "a")] * 5 + [(None, 1.0, "b")] * 3, "ts string, x double, name string", "ts")
    spec = SeriesSpec("ts", (), timedelta(hours=1), 24)
    got = rolling(df, spec, "x", 300, "mean", min_samples=3, out="m").collect()
    assert sorted((r["name"], r["m"] is None) for r in got) == [("a", False)] * 3 + [("a", True)] * 2 + [("b", True)] * 3


def _events(spark, n, instants, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"k": rng.integers(0, 2, n), "h": rng.integers(0, instants, n), "i": rng.permutation(n)})
    pdf["ts"] = BASE + pd.to_timedelta(pdf["h"], "m")
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")), pdf


@pytest.mark.parametrize("instants", [2000, 20])
def test_blocks_stay_bounded_when_rows_per_instant_grow(spark, instants):
    """A hundred times more rows per instant make more blocks, not larger ones."""
    df, pdf = _events(spark, 20000, instants)
    spec = SeriesSpec("ts", ("k",), timedelta(minutes=1), 1440, ("i",), most_rows=500)
    cut = with_blocks(df, spec)
    sizes = [r["count"] for r in cut.groupBy("k", BUCKET).count().collect()]
    assert max(sizes) < 1500 and len(sizes) > 20
    want = pdf.sort_values(["k", "ts", "i"]).groupby("k").cumcount()
    got = {r["i"]: r["row_idx"] for r in with_row_index(df, spec).collect()}
    assert got == dict(zip(pdf["i"], want.reindex(pdf.index), strict=True))


def test_fill_over_dense_blocks(spark):
    df, pdf = _events(spark, 4000, 10)
    df = df.withColumn("x", F.when(F.col("i") % 7 == 0, F.col("i")))
    spec = SeriesSpec("ts", ("k",), timedelta(minutes=1), 1440, ("i",), most_rows=100)
    pdf = pdf.sort_values(["k", "ts", "i"])
    pdf["x"] = pdf["i"].where(pdf["i"] % 7 == 0).groupby(pdf["k"]).ffill()
    got = {r["i"]: r["x"] for r in forward_fill(df, spec, ["x"]).collect()}
    assert all(got[i] == x or (got[i] is None and np.isnan(x)) for i, x in zip(pdf["i"], pdf["x"], strict=True))


@pytest.mark.parametrize("instants", [5000, 3])
def test_positions_are_found_by_counting(spark, monkeypatch, instants):
    monkeypatch.setattr(loadspark.series, "FEW", 200)
    monkeypatch.setattr(loadspark.series, "BINS", 16)
    df, pdf = _events(spark, 6000, instants, 3)
    order = pdf.sort_values(["ts", "k", "i"])["i"].tolist()
    wanted = [0, 1, 1999, 3000, 5999]
    assert {p: r["i"] for p, r in rows_at(df, ["ts", "k", "i"], wanted).items()} == {p: order[p] for p in wanted}
    with pytest.raises(ValueError):
        rows_at(df, ["ts", "k", "i"], [6000])


@pytest.mark.parametrize("q", [0.0, 0.37, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("accuracy", [20000, 3])
def test_quantiles_are_narrowed_by_counting(spark, monkeypatch, q, accuracy):
    """Smooth, two-humped, constant and far-flung values, with fences that miss and hardly any rows sorted at once."""
    import loadspark.operators.quantiles as quantiles

    monkeypatch.setattr(quantiles, "FEW", 3)
    monkeypatch.setattr(quantiles, "BINS", 8)
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "MARGIN", 0.01)
    rng = np.random.default_rng(7)
    parts = {
        "smooth": rng.normal(size=301), "humps": np.r_[np.zeros(100), np.full(100, 9.0)], "same": np.full(50, 2.5),
        "far": np.r_[rng.normal(size=60), [1.7e308, -1.7e308, 1e-300]], "one": np.array([4.0]),
    }
    pdf = pd.concat([pd.DataFrame({"g": g, "x": x}) for g, x in parts.items()])
    got = {r["g"]: r["quantile"] for r in group_quantile(spark.createDataFrame(pdf), ["g"], "x", q).collect()}
    want = spark.createDataFrame(pdf).groupBy("g").agg(F.percentile("x", q).alias("p")).collect()
    assert got.keys() == parts.keys()
    for r in want:
        assert got[r["g"]] == pytest.approx(r["p"], rel=1e-12, abs=1e-12)


def test_one_wrong_date_costs_one_key(spark):
    data = [("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 02:00:00", 2.0), ("b", "1990-05-05 03:00:00", 3.0), ("b", "1990-05-05 03:59:00", 4.0)]
    df = rows(spark, data, "k string, ts string, x double", "ts")
    spec = SeriesSpec("ts", ("k",), timedelta(hours=1))
    own = resample(df, spec, {"x": F.avg("x")}, whole_days=False, span="key")
    assert sorted((r["k"], r["ts"].hour, r["x"]) for r in own.collect()) == [("a", 0, 1.0), ("a", 1, None), ("a", 2, 2.0), ("b", 3, 3.5)]
    assert resample(df, spec, {"x": F.avg("x")}, span="key").count() == 48
    with pytest.raises(ValueError):
        resample(df, spec, {}, span="all")


def _short_series(n_keys: int) -> pd.DataFrame:
    """Series of all lengths from 1 to 40 rows, half of the values missing."""
    rng = np.random.default_rng(5)
    pdf = pd.concat([pd.DataFrame({"k": k, "i": np.arange(k % 40 + 1)}) for k in range(n_keys)], ignore_index=True)
    pdf["x"] = np.where(rng.random(len(pdf)) < 0.5, np.nan, rng.integers(0, 50, len(pdf)) / 4.0)
    pdf["ts"] = BASE + pd.to_timedelta(pdf["i"], "h")
    return pdf


@pytest.mark.parametrize("shift", [0, 3])
@pytest.mark.parametrize("batch", [7, 10000])
def test_blocks_rolled_together_do_not_meet(spark, batch, shift):
    """Many short series in one batch, and blocks over several batches, have the windows of their own rows only."""
    pdf = _short_series(300)
    df = spark.createDataFrame(pdf[["k", "ts", "x"]].sample(frac=1, random_state=2)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    spec = SeriesSpec("ts", ("k",), timedelta(hours=1), 10)
    rolls = [Roll("x", "med", "median"), Roll("x", "p90", "quantile", 0.9), Roll("x", "m"), Roll("x", "s", "std")]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = rolling_many(df, spec, rolls, 5, 2, shift).toPandas().sort_values(["k", "ts"]).reset_index(drop=True)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    windows = {"med": lambda w: w.median(), "p90": lambda w: w.quantile(0.9), "m": lambda w: w.mean(), "s": lambda w: w.std()}
    for out, fn in windows.items():
        want = pdf.groupby("k")["x"].transform(lambda s: fn(s.shift(shift).rolling(5, min_periods=2)))
        np.testing.assert_allclose(got[out].astype(float), want, atol=1e-9, equal_nan=True)


def test_rolling_starts_no_work_per_block(spark):
    """Blocks are rolled by the batch, and what is rolled is not joined back to the rows."""
    df, _ = series(spark, n=50)
    numbered = with_row_index(df, KEYED, "_idx")
    text = plan(roll_indexed(numbered, KEYED, [Roll("x", "med", "median")], 9, 3))
    assert "FlatMapGroups" not in text
    assert text.count("Join") == plan(numbered).count("Join")


def test_one_call_rolls_the_blocks_of_a_batch(monkeypatch):
    rows = pa.RecordBatch.from_pydict({"k": list(range(500)), "_of_x": [1.0] * 500, "_first": [True] * 500, "_own": [True] * 500})
    calls, rolling_of = [], pd.Series.rolling
    monkeypatch.setattr(pd.Series, "rolling", lambda *a, **k: calls.append(1) or rolling_of(*a, **k))
    out = list(_roll_block([Roll("x", "m", "median")], 3, 1, 0, ["k"])(iter([rows, rows])))
    assert sum(b.num_rows for b in out) == 1000 and len(calls) <= 3


def test_rolled_rows_keep_their_other_columns(spark):
    """Whole numbers beyond 2^53 with nulls beside them, far dates and rows without an instant come through unchanged."""
    data = [("0001-01-02", 2**60 + 1, 1.0), ("9999-12-30", None, 3.0), (None, 2**60 + 3, 5.0), (None, None, 5.0)]
    df = rows(spark, data, "ts string, id long, x double", "ts")
    got = rolling(df, SeriesSpec("ts", (), timedelta(hours=1), 24, ("id",)), "x", 300, "median", min_samples=1, out="m")
    seen = got.select(F.col("ts").cast("string").alias("ts"), "id", "x", "m").collect()
    key = lambda r: (r[0] or "", r[1] or 0)
    want = [("0001-01-02 00:00:00", 2**60 + 1, 1.0, 1.0), ("9999-12-30 00:00:00", None, 3.0, 2.0), (None, 2**60 + 3, 5.0, None), (None, None, 5.0, None)]
    assert sorted((tuple(r) for r in seen), key=key) == sorted(want, key=key)

"""Kernels with state kept between batches give what whole tables give."""

from __future__ import annotations

import math
import random

import pytest

from tickloom.plans.series import Series
from tickloom.plans.spec import REGISTRY, REQUIRED, Bound
from tickloom.streaming import stateful as S
from tickloom.streaming.live import BAR

from .test_series import walk


def plain(r):
    return tuple(None if x is None or x != x else x for x in r)


def same(got, want):
    """Equal but for the last bits, in which the two orders of addition may differ."""
    assert got.keys() == want.keys()
    for at, a in got.items():
        for x, y in zip(a, want[at], strict=True):
            assert x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9), (at, a, want[at])


def runner(spark, id, max_cache=1000, **params):
    return S.Runner(S.folds_of(spark.range(0), Bound.of(id, **params)), max_cache)


def rows_of(bars, price):
    middle = lambda r: (r[3] + r[4]) / 2 if price == "hl2" else r[5]
    return [(r[1], "upsert", (*map(float, r[2:7]), middle(r))) for r in bars]


RUNNING = ["EMA", "SMMA", "DEMA", "TEMA", "TRIX", "T3", "DYNAMIC", "KAMA", "MAMA", "HTL", "RSI", "CRSI", "PMO", "TSI", "MACD", "SMI", "ADX", "ALLIGATOR", "ATR-STOP", "SUPERTREND", "ATR", "FORCE", "KVO", "PVO", "HEIKINASHI", "HURST", "FISHER"]


@pytest.mark.parametrize("id", RUNNING)
def test_any_order_ends_as_the_whole(spark, id):
    op = REGISTRY[id]
    params = {p.name: p.shown for p in op.params if p.default is REQUIRED}
    bars = walk(160)
    want = {r.ts: plain(r[2:]) for r in Series(spark.createDataFrame(bars, BAR)).indicator(id, **params).df.collect()}
    run = runner(spark, id, **params)
    state = S.SeriesState(run.fresh(), run.fresh())
    rows = rows_of(bars, op.price if op.needs != "bars" else "close")
    random.Random(1).shuffle(rows)
    got: dict = {}
    for k in range(0, len(rows), 40):
        for at, kind, made in run.take(state, sorted(rows[k : k + 40])):
            got[at] = plain(made)
    same(got, want)


def test_pruned_state_goes_on(spark):
    bars = walk(120)
    run = runner(spark, "EMA", max_cache=10, lookback_periods=7)
    state = S.SeriesState(run.fresh(), run.fresh())
    rows, got = rows_of(bars, "close"), {}
    order = [*rows[:60], rows[61], rows[60], *rows[62:]]
    for r in order:
        got |= {at: plain(made) for at, _, made in run.take(state, [r])}
    want = {r.ts: plain(r[2:]) for r in Series(spark.createDataFrame(bars, BAR)).ema(7).df.collect()}
    same(got, want)
    assert len(state.times) == 10
    assert run.take(state, [(rows[3][0], "upsert", (1.0,) * 6)]) == []


def test_removal_correction_and_repeats(spark):
    run = runner(spark, "EMA", lookback_periods=3)
    state = S.SeriesState(run.fresh(), run.fresh())
    rows = rows_of(walk(12), "close")
    run.take(state, rows)
    gone = run.take(state, [(rows[5][0], "delete", rows[5][2])])
    assert gone[0] == (rows[5][0], "delete", None) and [g[0] for g in gone[1:]] == [r[0] for r in rows[6:]]
    changed = run.take(state, [(rows[8][0], "upsert", (5.0,) * 6)])
    assert [c[0] for c in changed] == [r[0] for r in rows[8:]]
    for _ in range(S.REPEATS):
        assert run.take(state, [(rows[8][0], "upsert", (5.0,) * 6)]) == []
    with pytest.raises(OverflowError):
        run.take(state, [(rows[8][0], "upsert", (5.0,) * 6)])


def test_only_running_calculations(spark):
    for id in ("SMA", "RENKO", "KELTNER"):
        with pytest.raises(ValueError):
            S.folds_of(spark.range(0), Bound.of(id, **({"lookback_periods": 3} if id == "SMA" else {"brick_size": 1} if id == "RENKO" else {})))


def test_stream(spark, tmp_path):
    bars = walk(30) + walk(30, "b", 2)
    source = str(tmp_path / "in")
    for k in (1, 0, 2):  # the second ten come first
        spark.createDataFrame([r for j, r in enumerate(bars) if j % 30 // 10 == k], BAR).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(BAR).option("maxFilesPerTrigger", 1).parquet(source)
    seen: dict = {}

    def sink(df, batch):
        seen.update({(r.series_key, r.ts): plain(r[2:-1]) for r in df.collect()})

    q = S.stream_operator(stream, "MACD", 3, 6, 3).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(sink).start()
    q.processAllAvailable()
    q.stop()
    want = {(r.series_key, r.ts): plain(r[2:]) for r in Series(spark.createDataFrame(bars, BAR)).macd(3, 6, 3).df.collect()}
    same(seen, want)

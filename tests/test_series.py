"""Chains, results, checks of parameters, bars and the catalog."""

from __future__ import annotations

import datetime as dt
import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.functions import kernels as K
from tickloom.operators.patterns import Bricks, Swings, exact
from tickloom.plans import catalog
from tickloom.plans.series import Series, pair
from tickloom.plans.spec import REGISTRY, Bound
from tickloom.sources import bars as B

BAR = "series_key string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
START = dt.datetime(2024, 1, 1)


def walk(n: int, key: str = "a", seed: int = 1, step: int = 3600) -> list[tuple]:
    rnd, price, out = random.Random(seed), 100.0, []
    for k in range(n):
        o = price
        price = max(1.0, price + rnd.gauss(0, 2))
        out.append((key, START + dt.timedelta(seconds=step * k), o, max(o, price) + rnd.random(), min(o, price) - rnd.random(), price, float(rnd.randint(0, 50))))
    return out


@pytest.fixture(scope="module")
def bars(spark):
    return Series(spark.createDataFrame(walk(150) + walk(150, "b", 2), BAR))


def column(series, name, key="a"):
    return [r[name] for r in series.df.filter(F.col("series_key") == key).orderBy("ts").collect()]


# ---------------------------------------------------------------- kernels by their definitions


@given(st.lists(st.one_of(st.floats(1, 100), st.just(math.nan)), max_size=40), st.integers(1, 6))
def test_ema_restarts_after_a_missing_value(values, n):
    step, e = K.ema(n), math.nan
    for i, x in enumerate(values):
        if i >= n - 1:
            e = sum(values[i - n + 1 : i + 1]) / n if math.isnan(e) else e + 2 / (n + 1) * (x - e)
        got = step(i, x)[0]
        assert math.isnan(got) if math.isnan(e) else got == pytest.approx(e)


@given(st.lists(st.floats(1, 100), min_size=1, max_size=60))
def test_oscillators_stay_in_range(values):
    step = K.rsi(5)
    for i, x in enumerate(values):
        r = step(i, x)[0]
        assert math.isnan(r) or 0 <= r <= 100


def test_flat_prices():
    for make, inputs in ((K.rsi(3), 1), (K.kama(10, 2, 30), 1), (K.fisher(10), 1), (K.tsi(5, 3, 2), 1), (K.adx(5), 3), (K.mama(0.5, 0.05), 1), (K.ht_trendline(), 1), (K.connors_rsi(3, 2, 10), 1)):
        for i in range(60):
            out = make(i, *[7.0] * inputs)
            assert all(x is None or isinstance(x, bool) or math.isnan(x) or math.isfinite(x) for x in out)


def test_adaptive_averages_follow_a_cycle():
    mama, trend = K.mama(0.5, 0.05), K.ht_trendline()
    for i in range(400):
        x = 100 + 10 * math.sin(2 * math.pi * i / 20)
        m, _ = mama(i, x)
        cycle, line, _ = trend(i, x)
    assert 85 < m < 115 and 95 < line < 105 and 15 <= cycle <= 25


def test_hurst_of_a_random_walk():
    rnd, step, x = random.Random(3), K.hurst(200), 1000.0
    for i in range(400):
        x *= math.exp(rnd.gauss(0, 0.01))
        h, corrected = step(i, x)
    assert 0.3 < h < 0.8 and corrected < h + 0.2
    assert math.isnan(K.hurst(20)(0, 1.0)[0])


def bricks_by_hand(rows, size):
    base = round(rows[0][5])
    top = bottom = base
    out = []
    for r in rows[1:]:
        while r[5] >= top + size:
            bottom, top = top, top + size
            out.append((r[1], bottom, top, True))
        while r[5] <= bottom - size:
            bottom, top = bottom - size, bottom
            out.append((r[1], top, bottom, False))
    return out


def test_renko(bars):
    got = [(r.ts, r.open, r.close, r.is_up) for r in bars.renko(2).df.filter("series_key = 'a'").orderBy("brick_no").collect()]
    assert got == bricks_by_hand(walk(150), 2)


def test_renko_by_range_and_atr(bars):
    assert bars.renko(2, end_type="high_low").df.count() > bars.renko(8).df.count()
    last = {r.series_key: r.atr for r in bars.atr(14).latest().collect()}
    for r in bars.renko_atr().df.collect():
        assert abs(r.close - r.open) == pytest.approx(last[r.series_key])


def test_bricks_share_volume_and_keep_decimals():
    b = Bricks(exact(0.1), False)
    b.push(1.0, 1.0, 1.0, 1.0)
    made = b.push(1.35, 0.9, 1.3, 9.0)
    assert [m[4] for m in made] == [1.1, 1.2, 1.3] and all(m[5] == 3.0 and m[2:4] == (1.35, 0.9) for m in made)


def zigzag_rows(high, low, close, percent):
    swings = Swings(exact(percent) / 100)
    made = [m for row in zip(high, low, close, strict=True) for m in swings.push(*row)]
    return made + swings.finish()


def test_zig_zag_holds_the_last_legs_only():
    rnd, price, most = random.Random(7), 100.0, 0
    swings = Swings(exact(5) / 100)
    for _ in range(20_000):
        price *= 1 + rnd.gauss(0, 0.01)
        swings.push(price, price, price)
        most = max(most, len(swings.rows))
    assert most < 1_000


def test_zig_zag_turns():
    prices = [100, 103, 110, 108, 104, 99, 101, 106, 112, 111]
    rows = zigzag_rows(prices, prices, prices, 5)
    assert [k for k, r in enumerate(rows) if r[1] == "H"] == [2] and [k for k, r in enumerate(rows) if r[1] == "L"] == [5]
    assert rows[0][0] is None and rows[4][0] == pytest.approx(110 + (99 - 110) * 2 / 3) and rows[9][:2] == (111.0, None)
    assert zigzag_rows([1.0], [1.0], [1.0], 5) == [(None, None, None, None)]


def test_zig_zag_query(bars):
    points = [x for x in column(bars.zigzag("close", 3), "point_type") if x]
    assert len(points) > 3 and all(a != b for a, b in zip(points, points[1:], strict=False))


# ---------------------------------------------------------------- chains and results


def test_chain_reads_the_chain_value(bars):
    chained = column(bars.atr(5).sma(3), "sma")
    atrp = column(bars.atr(5), "atrp")
    want = [None if i < 7 else sum(atrp[i - 2 : i + 1]) / 3 for i in range(150)]
    assert [x is None for x in chained] == [x is None for x in want]
    assert chained[7:] == pytest.approx(want[7:])


def test_chain_ends(bars):
    with pytest.raises(ValueError):
        bars.alligator().sma(3)
    with pytest.raises(ValueError):
        bars.ema(5).adx()
    with pytest.raises(AttributeError):
        bars.nothing(5)


def test_use_and_price_choice(bars):
    assert column(bars.use("hl2").sma(3), "sma") != column(bars.sma(3), "sma")
    a = [x for x in column(bars.awesome(), "oscillator") if x is not None]
    b = [x for x in column(bars.use("hl2").awesome(), "oscillator") if x is not None]
    assert a == pytest.approx(b)


def test_many_at_once_equal_one_by_one(bars):
    wanted = {"a": ("SMA", {"lookback_periods": 5}), "b": ("EMA", {"lookback_periods": 5}), "c": ("KELTNER", {}), "d": ("STC", {}), "e": ("EMA", {"lookback_periods": 5}), "f": ("GATOR", {}), "g": ("PSAR", {}), "h": ("BB", {})}
    whole = bars.indicators(wanted).orderBy("series_key", "ts").collect()
    for name, (id, params) in wanted.items():
        one = bars.indicator(id, **params)
        for r, x in zip(whole, one.df.orderBy("series_key", "ts").collect(), strict=True):
            for c in one.df.columns[2:]:
                assert r[f"{name}_{c}"] == (pytest.approx(x[c]) if isinstance(x[c], float) else x[c])


def test_many_at_once_shuffle_once(bars):
    plan = bars.indicators({"a": ("SMA", {"lookback_periods": 5}), "b": ("EMA", {"lookback_periods": 5}), "c": ("RSI", {})})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FlatMapGroupsInArrow") == 1


def test_condense_drop_find_latest(bars):
    e = bars.ema(10)
    assert e.condense().df.count() == 2 * 141
    assert e.drop_warmup().df.count() == 2 * (150 - 110)
    assert e.drop_warmup(149).df.count() == 2 and e.drop_warmup(1000).df.count() == 0
    with pytest.raises(ValueError):
        e.drop_warmup(-1)
    assert e.find(START + dt.timedelta(hours=20)).count() == 2 and e.find(dt.datetime(1999, 1, 1)).count() == 0
    assert {r.ts for r in e.latest().collect()} == {START + dt.timedelta(hours=149)}
    assert bars.kama().drop_warmup().df.count() == 2 * (150 - max(10 + 100, 100))
    assert bars.doji(0.5).condense().df.filter("match = 0").count() == 0
    assert bars.donchian(20).condense().df.count() == 2 * 130


def test_psar_without_a_reversal_and_stop_without_a_stop(spark):
    rising = [("a", START + dt.timedelta(hours=k), 10.0 + k, 11.0 + k, 9.9 + k, 10.5 + k, 1.0) for k in range(30)]
    s = Series(spark.createDataFrame(rising, BAR))
    assert set(column(s.psar(), "sar")) == {None}
    stops = column(s.vol_stop(7, 3), "sar")
    assert stops[:8] == [None] * 8 and None not in stops[8:]


def test_missing_values_spoil_only_their_frames(spark):
    rows = [("a", START + dt.timedelta(hours=k), None if k == 10 else float(k)) for k in range(30)]
    s = Series(spark.createDataFrame(rows, "series_key string, ts timestamp_ntz, v double"), value="v")
    sma = column(s.sma(5), "sma")
    assert [k for k, x in enumerate(sma) if x is None] == [0, 1, 2, 3, 10, 11, 12, 13, 14]
    ema = column(s.ema(5), "ema")
    assert [k for k, x in enumerate(ema) if x is None] == [0, 1, 2, 3, 10, 11, 12, 13, 14]


def test_pairs(spark, bars):
    a, b = (Series(bars.df.filter(F.col("series_key") == k).withColumn("series_key", F.lit("x"))) for k in "ab")
    r = pair("CORR", a, a, 20).df.filter("correlation is not null").collect()
    assert len(r) == 131 and all(x.correlation == pytest.approx(1) for x in r)
    beta = [x.beta for x in pair("BETA", a, b, 20).df.collect() if x.beta is not None]
    assert len(beta) == 130
    with pytest.raises(ValueError):
        pair("PRS", a, Series(b.df.filter("ts > '2024-01-02'")), strict=True).df.count()
    with pytest.raises(ValueError):
        a.corr()


@pytest.mark.parametrize("call", [("SMA", 0), ("EMA",), ("EMA", 5, 6), ("ADX", 1), ("MACD", 26, 12), ("ALMA", 9, 2.0), ("HURST", 19), ("ALLIGATOR", 5), ("PSAR", 0.3), ("STOCH", 14, 3, 3, 3.0, 2.0, "EMA"), ("MA-ENV", 20, 2.5, "KAMA"), ("PIVOT-POINTS", "year"), ("ZIGZAG", "open"), ("FRACTAL", 1), ("KVO", 2), ("UO", 7, 7, 28), ("BB", 1), ("RENKO", 0)])
def test_wrong_parameters(call):
    with pytest.raises(ValueError):
        Bound.of(*call)


def test_unknown_operator():
    with pytest.raises(KeyError):
        Bound.of("XYZ")


def test_empty_series(spark):
    none = Series(spark.createDataFrame([], BAR))
    for id, op in REGISTRY.items():
        if op.tier != "pair":
            params = {p.name: p.shown for p in op.params if p.default.__class__ is object}
            assert none.indicator(id, **params).df.count() == 0, id


def test_every_operator_on_every_point_type_and_end(bars):
    for kind in ("standard", "camarilla", "demark", "fibonacci", "woodie"):
        r = [x for x in bars.rolling_pivots(5, 1, kind).df.collect() if x.pp is not None]
        assert len(r) == 2 * 144 and all(x.s1 <= x.pp + 100 for x in r)
        assert any(x.pp for x in bars.pivot_points("day", kind).df.collect())
    for kind in ("ALMA", "DEMA", "EMA", "EPMA", "HMA", "SMA", "SMMA", "TEMA", "WMA"):
        assert bars.ma_env(10, 2.5, kind).condense().df.count() > 0
    assert bars.chexit(5, 3, "short").condense().df.count() == 2 * 145
    assert bars.atr_stop(end_type="high_low").condense().df.count() == 2 * 129
    assert column(bars.ichimoku(9, 26, 52, 0, 0), "chikou_span") == column(bars.use("close"), "value")


def test_vwap_start(bars):
    v = column(bars.vwap(start_date="2024-01-02 00:00:00"), "vwap")
    assert v[:24] == [None] * 24 and None not in v[30:]
    with pytest.raises(ValueError):
        bars.vwap(start_date="2020-01-01")


# ---------------------------------------------------------------- bars


def test_week_and_span_buckets(spark, bars):
    weeks = {r.ts for r in B.resample(bars, "1w").df.collect()}
    assert all(t.weekday() == 0 and t.hour == 0 for t in weeks)
    two = B.resample(bars, "2h").df.filter("series_key = 'a'").orderBy("ts").collect()
    src = walk(150)
    assert len(two) == 75 and two[0].open == src[0][2] and two[0].close == src[1][5] and two[0].volume == src[0][6] + src[1][6]
    assert B.seconds_of("2HR") == 7200 and B.seconds_of("1month") == 0
    with pytest.raises(ValueError):
        B.seconds_of("7x")
    with pytest.raises(ValueError):
        B.resample(bars, 0)


def test_gaps(spark):
    rows = [r for k, r in enumerate(walk(20)) if k not in (3, 4, 9)]
    got = B.fill_gaps(Series(spark.createDataFrame(rows, BAR)), "1h").df.orderBy("ts").collect()
    assert len(got) == 20
    assert {got[3].open, got[3].high, got[3].low, got[3].close, got[4].close} == {got[2].close} and got[3].volume == 0


def test_ticks_count_an_execution_once(spark):
    t = [("a", START, 1.0, 5.0, "x"), ("a", START, 1.0, 5.0, "x"), ("a", START, 2.0, 1.0, None), ("a", START, 2.0, 1.0, None), ("a", START, 3.0, 1.0, "")]
    df = spark.createDataFrame(t, "series_key string, ts timestamp_ntz, price double, volume double, execution_id string")
    bar = B.ticks_to_bars(df, "1m", execution_id="execution_id", order=["price"]).df.collect()
    assert [(b.open, b.close, b.volume) for b in bar] == [(1.0, 3.0, 8.0)]


def test_duplicates_are_refused(spark):
    rows = walk(3)
    twice = Series(spark.createDataFrame(rows + rows[:1], BAR))
    with pytest.raises(ValueError):
        B.validate(twice)
    assert B.validate(Series(spark.createDataFrame(rows, BAR))).df.count() == 3


def test_files_and_text(spark, bars, tmp_path):
    for fmt in ("parquet", "csv", "json", "orc"):
        B.write_bars(bars, str(tmp_path / fmt), fmt)
        assert B.read_bars(spark, str(tmp_path / fmt), fmt).df.count() == 300
    text = B.shown(bars.sma(3), rows=4).splitlines()
    assert len(text) == 9 and text[0].split() == ["i", "series_key", "ts", "sma"]
    assert B.as_bars(bars.df.withColumnRenamed("close", "last"), {"close": "last"}).sma(3).df.count() == 300
    assert {r.body_pct for r in B.to_candles(Series(spark.createDataFrame([("a", START, 1.0, 1.0, 1.0, 1.0, 0.0)], BAR))).collect()} == {1.0}


# ---------------------------------------------------------------- catalog


def test_catalog_counts_and_search():
    assert [len(catalog.listings(s)) for s in catalog.STYLES] == [85, 79, 79] and len(catalog.listings()) == 243
    assert catalog.get("ema").operator.name.startswith("Exponential") and catalog.get("nope") is None and catalog.get("BETA", "stream") is None
    assert {x.id for x in catalog.search("bollinger")} == {"BB"}
    assert len({x.id for x in catalog.listings(category="MovingAverage")}) == 15


def test_catalog_export(tmp_path):
    whole = json.loads(catalog.to_json(tmp_path / "c.json"))
    assert len(whole) == 243 and json.loads((tmp_path / "c.json").read_text()) == whole
    assert catalog.to_markdown_table().count("\n") == 86 and catalog.to_markdown_checklist().count("- [ ]") == 243


def test_execute_by_json(bars):
    got = catalog.execute_json(bars, json.dumps([{"id": "EMA", "parameters": {"lookbackPeriods": 5}}, {"id": "RSI"}]))
    assert column(got, "rsi") == column(bars.ema(5).rsi(14), "rsi")
    assert catalog.execute(bars, "PMO", {"smoothingPeriods": 5}).df.count() == 300
    with pytest.raises(ValueError):
        catalog.execute(bars, "BETA", {"lookbackPeriods": 5})


def test_own_operator(spark, bars):
    from tickloom.plans.spec import Param, operator

    @operator("TEST-SPREAD", "Spread", "Custom", [Param("times", 1.0, kind="double")], outputs=["spread"], value="spread", needs="bars")
    def spread(s, times):
        return s.give(spread=(F.col("high") - F.col("low")) * times)

    try:
        assert column(bars.test_spread(2.0).sma(1), "sma") == pytest.approx([2 * (r[3] - r[4]) for r in walk(150)])
    finally:
        del REGISTRY["TEST-SPREAD"]


def test_text_of_some_rows(bars):
    text = B.shown(bars.sma(3), rows=2, start=1, where="sma is not null", formats={"sma": ".1f", "ts": "%Y"})
    lines = text.splitlines()
    assert lines[0].split() == ["i", "series_key", "ts", "sma"] and len(lines) == 1 + 2 * bars.df.select("series_key").distinct().count()
    assert all(len(x.split()[-1].split(".")[1]) == 1 and x.split()[2].isdigit() for x in lines[1:])
    row = bars.sma(3).df.filter("sma is not null").first()
    assert B.shown_row(row, formats={"sma": ".2f"}).splitlines()[-1].split() == ["sma", f"{row.sma:.2f}"]


def test_interval_codes_and_ids():
    assert B.code_of(3600) == "1h" and B.code_of(0) == "1mo" and B.try_seconds_of("5min") == 300 and B.try_seconds_of("x") is None
    with pytest.raises(ValueError):
        B.code_of(7)
    from tickloom.plans.spec import operator

    with pytest.raises(ValueError):
        operator("MY OWN", "x", "y")


def test_rows_in_order(bars):
    made = [(r.series_key, r.ts) for r in bars.sma(3).in_order().collect()]
    assert made == sorted(made)

"""A series in parts gives what the whole series gives."""

from __future__ import annotations

import pytest

from tickloom.plans.series import Series
from tickloom.plans.spec import REGISTRY, REQUIRED
from tickloom.plans.split import BOUNDED, indicator_in_parts
from tickloom.streaming.live import BAR

from .test_series import walk


@pytest.fixture(scope="module")
def bars(spark):
    return Series(spark.createDataFrame(walk(400) + walk(30, "b", 2), BAR).repartition(3, "ts").cache())


def rows_of(series):
    return sorted((tuple(None if x is None else round(x, 8) if isinstance(x, float) else x for x in r) for r in series.df.collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("id", sorted(BOUNDED))
def test_parts_are_the_whole(bars, id):
    params = {p.name: p.shown for p in REGISTRY[id].params if p.default is REQUIRED}
    assert rows_of(indicator_in_parts(bars, id, rows=37, **params)) == rows_of(bars.indicator(id, **params))


def test_chain(bars):
    assert rows_of(indicator_in_parts(indicator_in_parts(bars, "SMA", 5, rows=50), "WMA", 4, rows=41)) == rows_of(bars.sma(5).wma(4))


def test_only_bounded_ones(bars):
    for id in ("EMA", "ADL", "PIVOTS"):
        with pytest.raises(ValueError):
            indicator_in_parts(bars, id, **({"lookback_periods": 5} if id == "EMA" else {}))
    with pytest.raises(ValueError):
        indicator_in_parts(bars, "STOCH", moving_average_type="SMMA")


def test_no_window_over_a_whole_series(bars):
    plan = indicator_in_parts(bars, "SMA", 5, rows=50).df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "_start" not in line and "_n#" not in line]
    assert windows and all("_part_of" in w or "_p#" in w for w in windows)

"""Moving averages."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans.spec import Param, need, operator
from ..plans.stage import NAN, Stage

CATEGORY = "MovingAverage"


def periods(default=None, low=2, high=250, **rest) -> Param:
    return Param("lookback_periods", low=low, high=high, **({"default": default} if default is not None else {}), **rest)


def at_least(least: int, *names: str):
    """A check that the named parameters (lookback_periods if none) are not less than least."""

    def check(**p) -> None:
        for name in names or ("lookback_periods",):
            need(p[name] >= least, f"{name} must be at least {least}")

    return check


def folded(s: Stage, inputs: list[str], outputs, make, *args) -> Stage:
    """Fold over the value in use (\"_x\" in inputs) and other columns."""
    return s.add(_x=s.v).fold(inputs, outputs, lambda: make(*args))


def wma_weights(n: int) -> list[float]:
    return [(j + 1) / (n * (n + 1) / 2) for j in range(n)]


@operator("SMA", "Simple Moving Average", CATEGORY, [periods(low=1, shown=20)], outputs=["sma"], value="sma", check=at_least(1))
def sma(s: Stage, lookback_periods: int) -> Stage:
    return s.give(sma=s.mean(s.v, lookback_periods))


@operator("EMA", "Exponential Moving Average", CATEGORY, [periods(shown=20)], outputs=["ema"], value="ema", tier="fold", check=at_least(1), warmup=lambda n, p: n + 1 + 100)
def ema(s: Stage, lookback_periods: int) -> Stage:
    return folded(s, ["_x"], ["ema"], K.ema, lookback_periods)


@operator("DEMA", "Double Exponential Moving Average", CATEGORY, [periods(14)], outputs=["dema"], value="dema", tier="fold", check=at_least(1), warmup=lambda n, p: 2 * (n + 1) + 100)
def dema(s: Stage, lookback_periods: int) -> Stage:
    return folded(s, ["_x"], ["dema"], K.dema, lookback_periods)


@operator("TEMA", "Triple Exponential Moving Average", CATEGORY, [periods(shown=20)], outputs=["tema"], value="tema", tier="fold", check=at_least(1), warmup=lambda n, p: 3 * (n + 1) + 100)
def tema(s: Stage, lookback_periods: int) -> Stage:
    return folded(s, ["_x"], ["tema"], K.tema, lookback_periods)


@operator("SMMA", "Smoothed Moving Average", CATEGORY, [periods(low=1, shown=20)], outputs=["smma"], value="smma", tier="fold", check=at_least(1), warmup=lambda n, p: n + 1 + 100)
def smma(s: Stage, lookback_periods: int) -> Stage:
    return folded(s, ["_x"], ["smma"], K.smma, lookback_periods)


def _t3(lookback_periods: int, volume_factor: float) -> None:
    need(lookback_periods > 0 and volume_factor > 0, "lookback_periods and volume_factor must be positive")


@operator("T3", "T3 Moving Average", CATEGORY, [periods(5, 1), Param("volume_factor", 0.7, 0.0, 1.0, kind="double")], outputs=["t3"], value="t3", tier="fold", check=_t3)
def t3(s: Stage, lookback_periods: int, volume_factor: float) -> Stage:
    return folded(s, ["_x"], ["t3"], K.t3, lookback_periods, volume_factor)


def _dynamic(lookback_periods: int, k_factor: float) -> None:
    need(lookback_periods > 0 and k_factor > 0, "lookback_periods and k_factor must be positive")


@operator("DYNAMIC", "McGinley Dynamic", CATEGORY, [periods(low=1, shown=14), Param("k_factor", 0.6, 0.1, 2.0, kind="double")], outputs=["dynamic"], value="dynamic", tier="fold", check=_dynamic)
def dynamic(s: Stage, lookback_periods: int, k_factor: float) -> Stage:
    return folded(s, ["_x"], ["dynamic"], K.dynamic, lookback_periods, k_factor)


def _kama(er_periods: int, fast_periods: int, slow_periods: int) -> None:
    need(er_periods > 0 and 0 < fast_periods < slow_periods, "er_periods must be positive, fast_periods positive and less than slow_periods")


@operator("KAMA", "Kaufman's Adaptive Moving Average", CATEGORY, [Param("er_periods", 10, 2, 250), Param("fast_periods", 2, 1, 50), Param("slow_periods", 30, 1, 250)], outputs=["er", "kama"], value="kama", tier="fold", check=_kama, warmup=lambda n, p: max(n + 100, 10 * n), warmup_on="er")
def kama(s: Stage, er_periods: int, fast_periods: int, slow_periods: int) -> Stage:
    return folded(s, ["_x"], ["er", "kama"], K.kama, er_periods, fast_periods, slow_periods)


def _mama(fast_limit: float, slow_limit: float) -> None:
    need(0 < slow_limit < fast_limit < 1, "0 < slow_limit < fast_limit < 1")


@operator("MAMA", "MESA Adaptive Moving Average", CATEGORY, [Param("fast_limit", 0.5, 0.01, 0.99, kind="double"), Param("slow_limit", 0.05, 0.01, 0.99, kind="double")], outputs=["mama", "fama"], value="mama", tier="fold", price="hl2", check=_mama, warmup=lambda n, p: 50)
def mama(s: Stage, fast_limit: float, slow_limit: float) -> Stage:
    return folded(s, ["_x"], ["mama", "fama"], K.mama, fast_limit, slow_limit)


@operator("HTL", "Hilbert Transform Instantaneous Trendline", CATEGORY, outputs=["dc_periods", "trendline", "smooth_price"], value="trendline", tier="fold", price="hl2", warmup=lambda n, p: 100)
def ht_trendline(s: Stage) -> Stage:
    return folded(s, ["_x"], {"dc_periods": "int", "trendline": "double", "smooth_price": "double"}, K.ht_trendline)


@operator("WMA", "Weighted Moving Average", CATEGORY, [periods(low=1, shown=14)], outputs=["wma"], value="wma", check=at_least(1))
def wma(s: Stage, lookback_periods: int) -> Stage:
    return s.give(wma=s.weighted(s.v, wma_weights(lookback_periods)))


@operator("HMA", "Hull Moving Average", CATEGORY, [periods(14)], outputs=["hma"], value="hma", check=at_least(2))
def hma(s: Stage, lookback_periods: int) -> Stage:
    n, root = lookback_periods, math.isqrt(lookback_periods)
    s = s.add(_half=s.weighted(s.v, wma_weights(n // 2)), _full=s.weighted(s.v, wma_weights(n)))
    s = s.add(_raw=F.coalesce(2 * F.col("_half") - F.col("_full"), F.lit(NAN)))
    return s.give(hma=s.weighted(F.col("_raw"), wma_weights(root), start=n + root - 2))


def _alma(lookback_periods: int, offset: float, sigma: float) -> None:
    need(lookback_periods > 1 and 0 <= offset <= 1 and sigma > 0, "lookback_periods > 1, 0 <= offset <= 1, sigma > 0")


def alma_weights(n: int, offset: float, sigma: float) -> list[float]:
    m, width = offset * (n - 1), n / sigma
    raw = [math.exp(-((j - m) ** 2) / (2 * width**2)) for j in range(n)]
    return [w / sum(raw) for w in raw]


@operator("ALMA", "Arnaud Legoux Moving Average (ALMA)", CATEGORY, [periods(9), Param("offset", 0.85, 0.0, 1.0, kind="double"), Param("sigma", 6.0, 0.1, 10.0, kind="double")], outputs=["alma"], value="alma", check=_alma)
def alma(s: Stage, lookback_periods: int, offset: float, sigma: float) -> Stage:
    return s.give(alma=s.weighted(s.v, alma_weights(lookback_periods, offset, sigma)))


def regression(s: Stage, n: int) -> dict:
    """Slope, intercept at x = row number + 1, and both mean squares of the last n rows."""
    middle = (n - 1) / 2
    x2 = n * (n * n - 1) / 12
    slope = s.weighted(s.v, [j - middle for j in range(n)]) / F.lit(x2)
    mean = s.mean(s.v, n)
    return {"slope": slope, "intercept": mean - slope * (s.i + 1 - middle), "mean": mean}


@operator("EPMA", "Endpoint Moving Average", CATEGORY, [periods(10, 1)], outputs=["epma"], value="epma", check=at_least(2))
def epma(s: Stage, lookback_periods: int) -> Stage:
    r = regression(s, lookback_periods)
    return s.give(epma=r["slope"] * (s.i + 1) + r["intercept"])


@operator("VWMA", "Volume Weighted Moving Average", CATEGORY, [periods(14, 1)], outputs=["vwma"], value="vwma", needs="bars", check=at_least(1))
def vwma(s: Stage, lookback_periods: int) -> Stage:
    n = lookback_periods
    return s.give(vwma=F.try_divide(s.total(F.col("close") * F.col("volume"), n), s.total(F.col("volume"), n)))

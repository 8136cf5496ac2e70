"""Price characteristics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans.spec import Param, need, operator
from ..plans.stage import NAN, Stage
from .channels import HLC
from .moving_averages import at_least, folded, periods, regression
from .oscillators import true_high_low

CATEGORY = "PriceCharacteristic"


@operator("ATR", "Average True Range (ATR)", CATEGORY, [periods(14)], outputs=["tr", "atr", "atrp"], value="atrp", needs="bars", tier="fold", check=at_least(2), warmup_on="atrp")
def atr(s: Stage, lookback_periods: int) -> Stage:
    return s.fold(HLC, ["tr", "atr", "atrp"], lambda: K.atr(lookback_periods))


@operator("TR", "True Range", CATEGORY, outputs=["tr"], value="tr", needs="bars")
def tr(s: Stage) -> Stage:
    s = true_high_low(s)
    return s.give(tr=F.col("_tr"))


@operator("STDEV", "Standard deviation", CATEGORY, [periods(14, 1)], outputs=["std_dev", "mean", "z_score"], value="std_dev", check=at_least(2))
def std_dev(s: Stage, lookback_periods: int) -> Stage:
    n = lookback_periods
    s = s.give(std_dev=s.from_row(n - 1, F.stddev_pop(s.v).over(s.last(n))), mean=s.mean(s.v, n))
    return s.give(z_score=F.try_divide(s.v - F.col("mean"), F.col("std_dev")))


@operator("SLOPE", "Slope", CATEGORY, [periods(14)], outputs=["slope", "intercept", "std_dev", "r_squared", "line"], value="slope", check=at_least(2), repaints=True)
def slope(s: Stage, lookback_periods: int) -> Stage:
    n = lookback_periods
    r = regression(s, n)
    s = s.give(slope=r["slope"], intercept=r["intercept"], std_dev=s.from_row(n - 1, F.stddev_pop(s.v).over(s.last(n))))
    spread_x = ((n * n - 1) / 12) ** 0.5
    root = F.try_divide(F.col("slope") * F.lit(spread_x), F.col("std_dev"))
    s = s.give(r_squared=root * root)
    # of the last n rows the frame ends with the series, and so with the last line
    to_end = s.rows(0, n - 1)
    line = F.last("slope").over(to_end) * (s.i + 1) + F.last("intercept").over(to_end)
    return s.give(line=F.when(~s.has(n) & (F.last("_i").over(to_end) >= n - 1), line))


@operator("SMA-ANALYSIS", "Simple Moving Average Analysis", CATEGORY, [periods(low=1, shown=20)], outputs=["sma", "mad", "mse", "mape"], value="sma", check=at_least(1))
def sma_analysis(s: Stage, lookback_periods: int) -> Stage:
    n = lookback_periods
    s = s.give(sma=s.mean(s.v, n)).add(_frame=F.collect_list(s.v).over(s.last(n)))
    total = lambda f: s.from_row(n - 1, F.aggregate("_frame", F.lit(0.0), lambda a, x: a + f(x - F.col("sma"), x)) / n)
    return s.give(mad=total(lambda d, x: F.abs(d)), mse=total(lambda d, x: d * d), mape=total(lambda d, x: F.abs(d) * F.try_divide(F.lit(1.0), x)))


@operator("ULCER", "Ulcer Index", CATEGORY, [periods(14, 1)], outputs=["ulcer_index"], value="ulcer_index", check=at_least(1))
def ulcer_index(s: Stage, lookback_periods: int) -> Stage:
    n = lookback_periods
    s = s.add(_frame=F.collect_list(s.v).over(s.last(n)))
    start = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("sum"))

    def step(a, x):
        top = F.greatest(a["top"], F.nanvl(x, a["top"]))
        fall = F.when(F.isnan(x), F.lit(NAN)).otherwise(100 * F.try_divide(x - top, top))
        return F.struct(top.alias("top"), (a["sum"] + fall * fall).alias("sum"))

    return s.give(ulcer_index=s.from_row(n - 1, F.sqrt(F.aggregate("_frame", start, step, lambda a: a["sum"]) / n)))


@operator("HURST", "Hurst Exponent", CATEGORY, [periods(100, 20)], outputs=["hurst_exponent", "hurst_exponent_al"], value="hurst_exponent", tier="fold", check=at_least(20))
def hurst(s: Stage, lookback_periods: int) -> Stage:
    return folded(s, ["_x"], ["hurst_exponent", "hurst_exponent_al"], K.hurst, lookback_periods)


BETA_TYPES = ("standard", "up", "down", "all")


def _beta(lookback_periods: int, type: str) -> None:
    need(lookback_periods > 0, "lookback_periods > 0")
    need(str(type).lower() in BETA_TYPES, f"type is one of {BETA_TYPES}")


@operator("BETA", "Beta", CATEGORY, [periods(low=1, shown=50), Param("type", "standard", kind="BetaType")], outputs=["beta", "beta_up", "beta_down", "ratio", "convexity", "returns_eval", "returns_mrkt"], value="beta", tier="pair", check=_beta, styles=["series"])
def beta(s: Stage, lookback_periods: int, type: str) -> Stage:
    """Of the returns of value_a against those of value_b, the market."""
    n, kind = lookback_periods, str(type).lower()
    change = lambda c: F.when(s.i == 0, 0.0).otherwise(F.coalesce(F.try_divide(F.col(c), s.lag(F.col(c))) - 1, F.when(s.lag(F.col(c)) == 0, 0.0), F.lit(NAN)))
    s = s.add(_a=change("value_a"), _b=change("value_b"))
    s = s.give(returns_eval=F.col("_a"), returns_mrkt=F.col("_b"))

    def over(keep):
        a, b = (F.when(keep, F.col(c)) for c in ("_a", "_b"))
        mean = lambda c: F.avg(c).over(s.last(n))
        return s.from_row(n, F.try_divide(mean(a * b) - mean(a) * mean(b), mean(b * b) - mean(b) * mean(b)))

    none = F.lit(None).cast("double")
    every, up, down = over(F.lit(True)), over(F.col("_b") > 0), over(F.col("_b") < 0)
    s = s.give(beta=every if kind in ("standard", "all") else none, beta_up=up if kind in ("up", "all") else none, beta_down=down if kind in ("down", "all") else none)
    ratio = F.try_divide(F.col("beta_up"), F.col("beta_down")) if kind == "all" else none
    bend = (F.col("beta_up") - F.col("beta_down")) * (F.col("beta_up") - F.col("beta_down")) if kind == "all" else none
    return s.give(ratio=ratio, convexity=bend)


def _prs(lookback_periods: int | None) -> None:
    need(lookback_periods is None or lookback_periods > 0, "lookback_periods > 0")


@operator("PRS", "Price Relative Strength", CATEGORY, [Param("lookback_periods", None, 1, 250, shown=20)], outputs=["prs", "prs_percent"], value="prs", tier="pair", check=_prs, styles=["series"])
def prs(s: Stage, lookback_periods: int | None) -> Stage:
    """Of value_a, relative to value_b, the base."""
    s = s.give(prs=F.try_divide(F.col("value_a"), F.col("value_b")))
    if lookback_periods is None:
        return s.give(prs_percent=F.lit(None).cast("double"))
    change = lambda c: F.try_divide(F.col(c) - s.lag(F.col(c), lookback_periods), s.lag(F.col(c), lookback_periods))
    return s.give(prs_percent=change("value_a") - change("value_b"))

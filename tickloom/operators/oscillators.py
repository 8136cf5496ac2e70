"""Oscillators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans.spec import Param, need, operator
from ..plans.stage import NAN, Stage
from .moving_averages import at_least, folded, periods

CATEGORY = "Oscillator"


def _fast_slow(fast_periods: int, slow_periods: int) -> None:
    need(0 < fast_periods < slow_periods, "0 < fast_periods < slow_periods")


@operator("AWESOME", "Awesome Oscillator", CATEGORY, [Param("fast_periods", 5, 1, 100), Param("slow_periods", 34, 1, 250)], outputs=["oscillator", "normalized"], value="oscillator", price="hl2", check=_fast_slow)
def awesome(s: Stage, fast_periods: int, slow_periods: int) -> Stage:
    s = s.give(oscillator=s.from_row(slow_periods - 1, F.avg(s.v).over(s.last(fast_periods)) - F.avg(s.v).over(s.last(slow_periods))))
    return s.give(normalized=100 * F.try_divide(F.col("oscillator"), s.v))


@operator("BOP", "Balance of Power (BOP)", CATEGORY, [Param("smooth_periods", 14, 1, 250)], outputs=["bop"], value="bop", needs="bars", check=at_least(1, "smooth_periods"))
def bop(s: Stage, smooth_periods: int) -> Stage:
    raw = F.coalesce(F.try_divide(F.col("close") - F.col("open"), F.col("high") - F.col("low")), F.lit(NAN))
    return s.give(bop=s.mean(raw, smooth_periods))


@operator("CCI", "Commodity Channel Index (CCI)", CATEGORY, [periods(20, 1)], outputs=["cci"], value="cci", needs="bars", check=at_least(1))
def cci(s: Stage, lookback_periods: int) -> Stage:
    n = lookback_periods
    s = s.add(_tp=(F.col("high") + F.col("low") + F.col("close")) / 3)
    s = s.add(_mean=s.mean(F.col("_tp"), n), _frame=F.collect_list("_tp").over(s.last(n)))
    dev = F.aggregate("_frame", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_mean"))) / n
    return s.give(cci=s.from_row(n - 1, F.try_divide(F.col("_tp") - F.col("_mean"), 0.015 * dev)))


def true_high_low(s: Stage) -> Stage:
    """Close of the row before as _pc, the true range as _tr: null on row 0."""
    s = s.add(_pc=s.lag(F.col("close")))
    high, low, before = F.col("high"), F.col("low"), F.col("_pc")
    return s.add(_tr=F.when(before.isNotNull(), F.greatest(high - low, F.abs(high - before), F.abs(low - before))))


@operator("CHOP", "Choppiness Index", CATEGORY, [periods(14, 1)], outputs=["chop"], value="chop", needs="bars", check=at_least(2))
def chop(s: Stage, lookback_periods: int) -> Stage:
    n = lookback_periods
    s = true_high_low(s)
    span = F.max(F.greatest("high", "_pc")).over(s.last(n)) - F.min(F.least("low", "_pc")).over(s.last(n))
    ratio = F.try_divide(F.sum("_tr").over(s.last(n)), span)
    return s.give(chop=s.from_row(n, F.when(ratio > 0, 100 * F.ln(ratio) / F.ln(F.lit(float(n))))))


@operator("CMO", "Chande Momentum Oscillator", CATEGORY, [periods(low=1, shown=14)], outputs=["cmo"], value="cmo", check=at_least(1))
def cmo(s: Stage, lookback_periods: int) -> Stage:
    n = lookback_periods
    s = s.add(_y=s.v)
    s = s.add(_d=F.col("_y") - s.lag(F.col("_y")))
    up = F.sum(F.when(F.isnan("_d"), F.lit(NAN)).otherwise(F.greatest(F.col("_d"), F.lit(0.0)))).over(s.last(n))
    down = F.sum(F.when(F.isnan("_d"), F.lit(NAN)).otherwise(F.greatest(-F.col("_d"), F.lit(0.0)))).over(s.last(n))
    return s.give(cmo=s.from_row(n, F.when(up + down == 0, F.lit(0.0)).otherwise(100 * F.try_divide(up - down, up + down))))


def _crsi(**p) -> None:
    need(min(p.values()) > 1, "all periods > 1")


@operator("CRSI", "ConnorsRSI (CRSI)", CATEGORY, [Param("rsi_periods", 3, 2, 250), Param("streak_periods", 2, 2, 50), Param("rank_periods", 100, 2, 250)], outputs=["streak", "rsi", "rsi_streak", "percent_rank", "connors_rsi"], value="connors_rsi", tier="fold", check=_crsi)
def connors_rsi(s: Stage, rsi_periods: int, streak_periods: int, rank_periods: int) -> Stage:
    return folded(s, ["_x"], ["streak", "rsi", "rsi_streak", "percent_rank", "connors_rsi"], K.connors_rsi, rsi_periods, streak_periods, rank_periods)


@operator("DPO", "Detrended Price Oscillator", CATEGORY, [periods(14)], outputs=["dpo", "sma"], value="dpo", check=at_least(1), repaints=True)
def dpo(s: Stage, lookback_periods: int) -> Stage:
    shift = lookback_periods // 2 + 1
    s = s.add(_sma=s.mean(s.v, lookback_periods))
    s = s.give(sma=s.from_row(max(0, lookback_periods - shift - 1), s.lead(F.col("_sma"), shift)))
    return s.give(dpo=s.v - F.col("sma"))


@operator("GATOR", "Gator Oscillator", CATEGORY, outputs=["upper", "lower", "upper_is_expanding", "lower_is_expanding"], value=None, price="hl2", tier="fold", warmup=lambda n, p: 150)
def gator(s: Stage) -> Stage:
    s = folded(s, ["_x"], ["_jaw", "_teeth", "_lips"], K.alligator, ((13, 8), (8, 5), (5, 3))).ready()
    s = s.give(upper=F.when(s.i > 0, F.abs(F.col("_jaw") - F.col("_teeth"))), lower=F.when(s.i > 0, -F.abs(F.col("_teeth") - F.col("_lips"))))
    return s.add(upper_is_expanding=F.col("upper") > s.lag(F.col("upper")), lower_is_expanding=F.col("lower") < s.lag(F.col("lower")))


def _pmo(time_periods: int, smooth_periods: int, signal_periods: int) -> None:
    need(time_periods > 1 and smooth_periods > 0 and signal_periods > 0, "time_periods > 1, others > 0")


@operator("PMO", "Price Momentum Oscillator", CATEGORY, [Param("time_periods", 35, 1, 250), Param("smooth_periods", 20, 1, 100), Param("signal_periods", 10, 1, 50)], outputs=["pmo", "signal"], value="pmo", tier="fold", check=_pmo, warmup=lambda n, p: n + 1 + 250)
def pmo(s: Stage, time_periods: int, smooth_periods: int, signal_periods: int) -> Stage:
    return folded(s, ["_x"], ["pmo", "signal"], K.pmo, time_periods, smooth_periods, signal_periods)


@operator("ROC", "Rate of Change", CATEGORY, [periods(14, 1)], outputs=["momentum", "roc"], value="roc", check=at_least(1))
def roc(s: Stage, lookback_periods: int) -> Stage:
    s = s.add(_y=s.v)
    s = s.add(_back=s.lag(F.col("_y"), lookback_periods))
    return s.give(momentum=F.col("_y") - F.col("_back"), roc=100 * F.try_divide(F.col("_y") - F.col("_back"), F.col("_back")))


@operator("RSI", "Relative Strength Index", CATEGORY, [periods(14, 1)], outputs=["rsi"], value="rsi", tier="fold", check=at_least(1), warmup=lambda n, p: 10 * n)
def rsi(s: Stage, lookback_periods: int) -> Stage:
    return folded(s, ["_x"], ["rsi"], K.rsi, lookback_periods)


SMI_PARAMS = [periods(13, 1, 300), Param("first_smooth_periods", 25, 1, 300), Param("second_smooth_periods", 2, 1, 50), Param("signal_periods", 3, 1, 50)]


@operator("SMI", "Stochastic Momentum Index", CATEGORY, SMI_PARAMS, outputs=["smi", "signal"], value="smi", needs="bars", tier="fold", check=at_least(1, *(p.name for p in SMI_PARAMS)), warmup=lambda n, p: n + 2 + 100)
def smi(s: Stage, lookback_periods: int, first_smooth_periods: int, second_smooth_periods: int, signal_periods: int) -> Stage:
    return s.fold(["high", "low", "close"], ["smi", "signal"], lambda: K.smi(lookback_periods, first_smooth_periods, second_smooth_periods, signal_periods))


def raw_stochastic(s: Stage, n: int, high: str, low: str, close: str) -> Column:
    """Place of close between the least low and the greatest high of n rows, 0 to 100; NaN if a row is missing."""
    whole = F.count(F.when(~(F.isnan(high) | F.isnan(low) | F.isnan(close)), 1)).over(s.last(n)) == n
    top, bottom, c = F.max(high).over(s.last(n)), F.min(low).over(s.last(n)), F.col(close)
    value = F.when(top == bottom, 0.0).when(c >= top, 100.0).when(c <= bottom, 0.0).otherwise(100 * F.try_divide(c - bottom, top - bottom))
    return F.when(whole, value).otherwise(F.lit(NAN))


def smoothed_stochastic(s: Stage, raw: Column, smooth: int, signal: int, k_factor: float = 3, d_factor: float = 2) -> Stage:
    s = s.add(_raw=raw)
    k = F.col("_raw") if smooth <= 1 else F.when(s.i >= smooth, F.avg("_raw").over(s.last(smooth))).otherwise(F.lit(NAN))
    s = s.add(_k=k)
    d = F.col("_k") if signal <= 1 else F.when(s.i >= signal, F.avg("_k").over(s.last(signal))).otherwise(F.lit(NAN))
    s = s.add(_d=d)
    return s.give(oscillator=F.col("_k"), signal=F.col("_d"), percent_j=k_factor * F.col("_k") - d_factor * F.col("_d"))


def _stoch(lookback_periods: int, signal_periods: int, smooth_periods: int, k_factor: float, d_factor: float, moving_average_type: str) -> None:
    need(min(lookback_periods, signal_periods, smooth_periods, k_factor, d_factor) > 0, "all numbers > 0")
    need(str(moving_average_type).upper() in ("SMA", "SMMA"), "moving_average_type is SMA or SMMA")


@operator("STOCH", "Stochastic Oscillator", CATEGORY, [periods(14, 1), Param("signal_periods", 3, 1, 250), Param("smooth_periods", 3, 1, 50), Param("k_factor", 3.0, kind="double"), Param("d_factor", 2.0, kind="double"), Param("moving_average_type", "SMA", kind="MaType")], outputs=["oscillator", "signal", "percent_j"], value="oscillator", needs="bars", check=_stoch)
def stoch(s: Stage, lookback_periods: int, signal_periods: int, smooth_periods: int, k_factor: float, d_factor: float, moving_average_type: str) -> Stage:
    raw = raw_stochastic(s, lookback_periods, "high", "low", "close")
    if str(moving_average_type).upper() == "SMMA":
        return s.add(_raw=raw).fold(["_raw"], ["oscillator", "signal", "percent_j"], lambda: K.stoch_smoothed(smooth_periods, signal_periods, k_factor, d_factor))
    return smoothed_stochastic(s, raw, smooth_periods, signal_periods, k_factor, d_factor)


def _stoch_of(s: Stage, n: int, smooth: int, signal: int) -> Stage:
    """Stochastic of one column _z that is NaN where missing."""
    return smoothed_stochastic(s, raw_stochastic(s, n, "_z", "_z", "_z"), smooth, signal)


STOCH_RSI_PARAMS = [Param("rsi_periods", 14, 1, 250), Param("stoch_periods", 14, 1, 250), Param("signal_periods", 3, 1, 50), Param("smooth_periods", 1, 1, 50)]


@operator("STOCH-RSI", "Stochastic RSI", CATEGORY, STOCH_RSI_PARAMS, outputs=["stoch_rsi", "signal"], value="stoch_rsi", tier="fold", check=at_least(1, *(p.name for p in STOCH_RSI_PARAMS)), warmup=lambda n, p: n + 2 + 100)
def stoch_rsi(s: Stage, rsi_periods: int, stoch_periods: int, signal_periods: int, smooth_periods: int) -> Stage:
    s = folded(s, ["_x"], ["_rsi"], K.rsi, rsi_periods).ready()
    s = s.add(_z=F.coalesce(F.col("_rsi"), F.lit(NAN)))
    # the inner series starts where the strength does, so its rows are counted from there
    inner = s.i - rsi_periods
    s = s.add(_raw=F.when(inner >= stoch_periods - 1, raw_stochastic(s, stoch_periods, "_z", "_z", "_z")).otherwise(F.lit(NAN)))
    k = F.col("_raw") if smooth_periods <= 1 else F.when(inner >= smooth_periods, F.avg("_raw").over(s.last(smooth_periods))).otherwise(F.lit(NAN))
    s = s.add(_k=k)
    d = F.col("_k") if signal_periods <= 1 else F.when(inner >= signal_periods, F.avg("_k").over(s.last(signal_periods))).otherwise(F.lit(NAN))
    first = rsi_periods + stoch_periods - 1
    return s.give(stoch_rsi=s.from_row(first, F.col("_k")), signal=s.from_row(first, d))


def _stc(cycle_periods: int, fast_periods: int, slow_periods: int) -> None:
    need(cycle_periods >= 0 and 0 < fast_periods < slow_periods, "cycle_periods >= 0, 0 < fast_periods < slow_periods")


@operator("STC", "Schaff Trend Cycle", CATEGORY, [Param("cycle_periods", 10, 1, 250), Param("fast_periods", 23, 1, 250), Param("slow_periods", 50, 1, 250)], outputs=["stc"], value="stc", tier="fold", check=_stc, warmup=lambda n, p: n + 250)
def stc(s: Stage, cycle_periods: int, fast_periods: int, slow_periods: int) -> Stage:
    s = folded(s, ["_x"], ["_macd", "_fast", "_slow"], K.averages, fast_periods, slow_periods).ready()
    s = s.add(_z=F.coalesce(F.col("_macd"), F.lit(NAN)))
    s = _stoch_of(s, max(cycle_periods, 1), 3, 1)
    return s.give(stc=F.col("oscillator"))


@operator("TRIX", "Triple Exponential Moving Average Oscillator", CATEGORY, [periods(14, 1)], outputs=["ema3", "trix"], value="trix", tier="fold", check=at_least(1), warmup=lambda n, p: 3 * n + 100)
def trix(s: Stage, lookback_periods: int) -> Stage:
    return folded(s, ["_x"], ["ema3", "trix"], K.trix, lookback_periods)


def _tsi(lookback_periods: int, smooth_periods: int, signal_periods: int) -> None:
    need(lookback_periods > 0 and smooth_periods > 0 and signal_periods >= 0, "periods > 0, signal_periods >= 0")


@operator("TSI", "True Strength Index", CATEGORY, [periods(25, 1), Param("smooth_periods", 13, 1, 250), Param("signal_periods", 7, 1, 50)], outputs=["tsi", "signal"], value="tsi", tier="fold", check=_tsi, warmup=lambda n, p: n + 1 + 250)
def tsi(s: Stage, lookback_periods: int, smooth_periods: int, signal_periods: int) -> Stage:
    return folded(s, ["_x"], ["tsi", "signal"], K.tsi, lookback_periods, smooth_periods, signal_periods)


def _ultimate(short_periods: int, middle_periods: int, long_periods: int) -> None:
    need(0 < short_periods < middle_periods < long_periods, "0 < short_periods < middle_periods < long_periods")


@operator("UO", "Ultimate Oscillator", CATEGORY, [Param("short_periods", 7, 1, 50), Param("middle_periods", 14, 1, 50), Param("long_periods", 28, 1, 250)], outputs=["ultimate"], value="ultimate", needs="bars", check=_ultimate)
def ultimate(s: Stage, short_periods: int, middle_periods: int, long_periods: int) -> Stage:
    s = true_high_low(s)
    s = s.add(_bp=F.col("close") - F.least("low", "_pc"))
    part = lambda n: F.try_divide(F.sum("_bp").over(s.last(n)), F.sum("_tr").over(s.last(n)))
    return s.give(ultimate=s.from_row(long_periods, 100 * (4 * part(short_periods) + 2 * part(middle_periods) + part(long_periods)) / 7))


@operator("WILLR", "Williams %R", CATEGORY, [periods(14, 1)], outputs=["williams_r"], value="williams_r", needs="bars", check=at_least(1))
def williams_r(s: Stage, lookback_periods: int) -> Stage:
    return s.give(williams_r=raw_stochastic(s, lookback_periods, "high", "low", "close") - 100)


def _correlation(lookback_periods: int) -> None:
    need(lookback_periods > 0, "lookback_periods > 0")


@operator("CORR", "Correlation", CATEGORY, [periods(20, 1)], outputs=["variance_a", "variance_b", "covariance", "correlation", "r_squared"], value="correlation", tier="pair", check=_correlation, styles=["series"])
def correlation(s: Stage, lookback_periods: int) -> Stage:
    n = lookback_periods
    a, b = F.coalesce("value_a", F.lit(NAN)), F.coalesce("value_b", F.lit(NAN))
    mean = lambda c: s.mean(c, n)
    s = s.give(variance_a=mean(a * a) - mean(a) * mean(a), variance_b=mean(b * b) - mean(b) * mean(b), covariance=mean(a * b) - mean(a) * mean(b))
    both = F.col("variance_a") * F.col("variance_b")
    s = s.give(correlation=F.when(both > 0, F.try_divide(F.col("covariance"), F.sqrt(both))))
    return s.give(r_squared=F.col("correlation") * F.col("correlation"))

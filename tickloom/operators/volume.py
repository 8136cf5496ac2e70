"""Operators on volume."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans.spec import Param, need, operator
from ..plans.stage import Stage
from .moving_averages import at_least, periods
from .trends import _macd

CATEGORY = "VolumeBased"


def money_flow(s: Stage) -> Stage:
    """Where the close lies in its range (-1 to 1, 0 without a range), and that times the volume."""
    c, h, low = F.col("close"), F.col("high"), F.col("low")
    s = s.add(money_flow_multiplier=F.when(h == low, 0.0).otherwise(F.try_divide((c - low) - (h - c), h - low)))
    return s.add(money_flow_volume=F.col("money_flow_multiplier") * F.col("volume"))


@operator("ADL", "Accumulation Distribution Line (ADL)", CATEGORY, outputs=["money_flow_multiplier", "money_flow_volume", "adl"], value="adl", needs="bars")
def adl(s: Stage) -> Stage:
    s = money_flow(s)
    return s.give(adl=F.sum("money_flow_volume").over(s.past))


@operator("CHAIKIN-OSC", "Chaikin Money Flow Oscillator", CATEGORY, [Param("fast_periods", 3, 1, 100), Param("slow_periods", 10, 1, 100)], outputs=["money_flow_multiplier", "money_flow_volume", "adl", "oscillator", "fast_ema", "slow_ema"], value="oscillator", needs="bars", tier="fold", check=lambda fast_periods, slow_periods: need(0 < fast_periods < slow_periods, "0 < fast_periods < slow_periods"), warmup=lambda n, p: n + 1 + 100)
def chaikin_osc(s: Stage, fast_periods: int, slow_periods: int) -> Stage:
    return adl(s).fold(["adl"], ["oscillator", "fast_ema", "slow_ema"], lambda: K.averages(fast_periods, slow_periods))


@operator("CMF", "Chaikin Money Flow (CMF)", CATEGORY, [periods(20, 1)], outputs=["money_flow_multiplier", "money_flow_volume", "cmf"], value="cmf", needs="bars", check=at_least(1))
def cmf(s: Stage, lookback_periods: int) -> Stage:
    s = money_flow(s)
    return s.give(cmf=F.try_divide(s.total(F.col("money_flow_volume"), lookback_periods), s.total(F.col("volume"), lookback_periods)))


@operator("FORCE", "Force Index", CATEGORY, [periods(2, 1)], outputs=["force_index"], value="force_index", needs="bars", tier="fold", check=at_least(1), warmup=lambda n, p: n + 100)
def force_index(s: Stage, lookback_periods: int) -> Stage:
    return s.fold(["close", "volume"], ["force_index"], lambda: K.force_index(lookback_periods))


@operator("KVO", "Klinger Volume Oscillator", CATEGORY, [Param("fast_periods", 34, 3, 200), Param("slow_periods", 55, 4, 250), Param("signal_periods", 13, 1, 50)], outputs=["oscillator", "signal"], value="oscillator", needs="bars", tier="fold", check=lambda fast_periods, slow_periods, signal_periods: need(2 < fast_periods < slow_periods and signal_periods > 0, "2 < fast_periods < slow_periods, signal_periods > 0"), warmup=lambda n, p: n - 1 + 150)
def kvo(s: Stage, fast_periods: int, slow_periods: int, signal_periods: int) -> Stage:
    return s.fold(["high", "low", "close", "volume"], ["oscillator", "signal"], lambda: K.kvo(fast_periods, slow_periods, signal_periods))


@operator("MFI", "Money Flow Index (MFI)", CATEGORY, [periods(14, 1)], outputs=["mfi"], value="mfi", needs="bars", check=at_least(2))
def mfi(s: Stage, lookback_periods: int) -> Stage:
    n = lookback_periods
    s = s.add(_tp=(F.col("high") + F.col("low") + F.col("close")) / 3)
    s = s.add(_last=s.lag(F.col("_tp")), _flow=F.col("_tp") * F.col("volume"))
    plus = F.sum(F.when(F.col("_tp") > F.col("_last"), F.col("_flow")).otherwise(0.0)).over(s.last(n))
    minus = F.sum(F.when(F.col("_tp") < F.col("_last"), F.col("_flow")).otherwise(0.0)).over(s.last(n))
    return s.give(mfi=s.from_row(n, F.when(minus == 0, 100.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(plus, minus)))))


@operator("OBV", "On-Balance Volume", CATEGORY, outputs=["obv"], value="obv", needs="bars")
def obv(s: Stage) -> Stage:
    s = s.add(_move=F.coalesce(F.signum(F.col("close") - s.lag(F.col("close"))), F.lit(0.0)) * F.col("volume"))
    return s.give(obv=F.sum("_move").over(s.past))


@operator("PVO", "Price Volume Oscillator", CATEGORY, [Param("fast_periods", 12, 1, 100), Param("slow_periods", 26, 1, 250), Param("signal_periods", 9, 1, 50)], outputs=["pvo", "signal", "histogram"], value="pvo", needs="bars", tier="fold", check=_macd, warmup=lambda n, p: n + 2 + 250, warmup_on="signal")
def pvo(s: Stage, fast_periods: int, slow_periods: int, signal_periods: int) -> Stage:
    return s.fold(["volume"], ["pvo", "signal", "histogram"], lambda: K.pvo(fast_periods, slow_periods, signal_periods))

"""Price channels and bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans.spec import Bound, Param, need, operator
from ..plans.stage import Stage
from .moving_averages import at_least, folded, periods

CATEGORY = "PriceChannel"
HLC = ["high", "low", "close"]


def atr_columns(s: Stage, n: int) -> Stage:
    """The average true range as _atr, once the folds have run."""
    return s.fold(HLC, ["_tr", "_atr", "_atrp"], lambda: K.atr(n))


def _bands(lookback_periods: int, standard_deviations: float) -> None:
    need(lookback_periods > 1 and standard_deviations > 0, "lookback_periods > 1, standard_deviations > 0")


@operator("BB", "Bollinger Bands", CATEGORY, [periods(20), Param("standard_deviations", 2.0, 0.01, 10.0, kind="double")], outputs=["sma", "upper_band", "lower_band", "percent_b", "z_score", "width"], value="percent_b", check=_bands, warmup_on="width")
def bollinger_bands(s: Stage, lookback_periods: int, standard_deviations: float) -> Stage:
    n = lookback_periods
    s = s.give(sma=s.mean(s.v, n), _sd=s.from_row(n - 1, F.stddev_pop(s.v).over(s.last(n)) * standard_deviations))
    s = s.give(upper_band=F.col("sma") + F.col("_sd"), lower_band=F.col("sma") - F.col("_sd"))
    span = F.col("upper_band") - F.col("lower_band")
    return s.give(percent_b=F.try_divide(s.v - F.col("lower_band"), span), z_score=F.try_divide(s.v - F.col("sma"), F.col("_sd") / standard_deviations), width=F.try_divide(span, F.col("sma")))


@operator("DONCHIAN", "Donchian Channels", CATEGORY, [periods(20, 1)], outputs=["upper_band", "centerline", "lower_band", "width"], value=None, needs="bars", check=at_least(1), warmup_on="width")
def donchian(s: Stage, lookback_periods: int) -> Stage:
    n = lookback_periods
    before = s.rows(-n, -1)
    s = s.give(upper_band=s.from_row(n, F.max("high").over(before)), lower_band=s.from_row(n, F.min("low").over(before)))
    s = s.give(centerline=(F.col("upper_band") + F.col("lower_band")) / 2)
    return s.give(width=F.try_divide(F.col("upper_band") - F.col("lower_band"), F.col("centerline")))


def fractal_columns(s: Stage, left: int, right: int, end_type: str) -> Stage:
    """_bear and _bull: a high (or low) beyond all of the rows beside it; null near both ends."""
    high, low = ("close", "close") if end_type == "close" else ("high", "low")
    inside = (s.i >= left) & s.has(right)
    before, after = s.rows(-left, -1), s.rows(1, right)
    bear = inside & (F.col(high) > F.max(high).over(before)) & (F.col(high) > F.max(high).over(after))
    bull = inside & (F.col(low) < F.min(low).over(before)) & (F.col(low) < F.min(low).over(after))
    return s.add(_bear=F.when(bear, F.col(high)), _bull=F.when(bull, F.col(low)))


def end_type_of(value: str) -> str:
    need(str(value).lower().replace("_", "") in ("close", "highlow"), "end_type is close or high_low")
    return "close" if str(value).lower() == "close" else "high_low"


@operator("FCB", "Fractal Chaos Bands", CATEGORY, [Param("window_span", 2, 2, 30)], outputs=["upper_band", "lower_band"], value=None, needs="bars", check=at_least(2, "window_span"), warmup_on="upper_band")
def fcb(s: Stage, window_span: int) -> Stage:
    s = fractal_columns(s, window_span, window_span, "high_low")
    late = s.add(_late_bear=s.lag(F.col("_bear"), window_span), _late_bull=s.lag(F.col("_bull"), window_span))
    return late.give(upper_band=F.last("_late_bear", ignorenulls=True).over(s.past), lower_band=F.last("_late_bull", ignorenulls=True).over(s.past))


def _keltner(ema_periods: int, multiplier: float, atr_periods: int) -> None:
    need(ema_periods > 1 and atr_periods > 1 and multiplier > 0, "periods > 1, multiplier > 0")


@operator("KELTNER", "Keltner Channels", CATEGORY, [Param("ema_periods", 20, 2, 250), Param("multiplier", 2.0, 0.01, 10.0, kind="double"), Param("atr_periods", 10, 2, 250)], outputs=["upper_band", "centerline", "lower_band", "width"], value=None, needs="bars", tier="fold", check=_keltner, warmup=lambda n, p: max(2 * (n + 1), n + 1 + 100), warmup_on="width")
def keltner(s: Stage, ema_periods: int, multiplier: float, atr_periods: int) -> Stage:
    s = atr_columns(s, atr_periods).fold(["close"], ["_ema"], lambda: K.ema(ema_periods)).ready()
    first = max(ema_periods, atr_periods) - 1
    s = s.give(centerline=s.from_row(first, F.col("_ema")), _band=s.from_row(first, F.col("_atr") * multiplier))
    s = s.give(upper_band=F.col("centerline") + F.col("_band"), lower_band=F.col("centerline") - F.col("_band"))
    return s.give(width=F.try_divide(F.col("upper_band") - F.col("lower_band"), F.col("centerline")))


def _starc(sma_periods: int, multiplier: float, atr_periods: int) -> None:
    need(sma_periods > 1 and atr_periods > 1 and multiplier > 0, "periods > 1, multiplier > 0")


@operator("STARC", "STARC Bands", CATEGORY, [Param("sma_periods", 5, 1, 50), Param("multiplier", 2.0, 1.0, 10.0, kind="double"), Param("atr_periods", 10, 1, 50)], outputs=["upper_band", "centerline", "lower_band"], value=None, needs="bars", tier="fold", check=_starc, warmup=lambda n, p: n + 1 + 150, warmup_on="upper_band")
def starc_bands(s: Stage, sma_periods: int, multiplier: float, atr_periods: int) -> Stage:
    s = atr_columns(s.give(centerline=s.mean(F.col("close"), sma_periods)), atr_periods).ready()
    return s.give(upper_band=F.col("centerline") + multiplier * F.col("_atr"), lower_band=F.col("centerline") - multiplier * F.col("_atr"))


#: Averages that envelopes may use, and the output of each.
ENVELOPE_TYPES = {"ALMA": "alma", "DEMA": "dema", "EMA": "ema", "EPMA": "epma", "HMA": "hma", "SMA": "sma", "SMMA": "smma", "TEMA": "tema", "WMA": "wma"}


def _envelopes(lookback_periods: int, percent_offset: float, moving_average_type: str) -> None:
    need(percent_offset > 0, "percent_offset > 0")
    need(str(moving_average_type).upper() in ENVELOPE_TYPES, f"moving_average_type is one of {sorted(ENVELOPE_TYPES)}")
    Bound.of(moving_average_type, lookback_periods)


@operator("MA-ENV", "Moving Average Envelopes", CATEGORY, [periods(20, 1), Param("percent_offset", 2.5, 0.1, 10.0, kind="double"), Param("moving_average_type", "SMA", kind="MaType")], outputs=["centerline", "upper_envelope", "lower_envelope"], value=None, tier="fold", check=_envelopes)
def ma_envelopes(s: Stage, lookback_periods: int, percent_offset: float, moving_average_type: str) -> Stage:
    inner = Bound.of(moving_average_type, lookback_periods)
    s = inner.operator.build(s, **inner.params).ready()
    center = F.col(ENVELOPE_TYPES[str(moving_average_type).upper()])
    return s.give(centerline=center, upper_envelope=center * (1 + percent_offset / 100), lower_envelope=center * (1 - percent_offset / 100))


def _channels(lookback_periods: int, std_deviations: float) -> None:
    need(lookback_periods > 1 and std_deviations > 0, "lookback_periods > 1, std_deviations > 0")


@operator("STDEV-CHANNELS", "Standard Deviation Channels", CATEGORY, [periods(20, 1), Param("std_deviations", 2.0, 0.01, 10.0, kind="double")], outputs=["centerline", "upper_channel", "lower_channel", "break_point"], value=None, tier="whole", check=_channels, styles=["series"], repaints=True, warmup_on="upper_channel")
def stdev_channels(s: Stage, lookback_periods: int, std_deviations: float) -> Stage:
    from pyspark.sql import Window

    n = lookback_periods
    s = s.summed(_count=F.count(F.lit(1)))
    s = s.add(_part=F.floor((F.col("_count") - 1 - s.i) / n), _whole=F.floor(F.col("_count") / n), _y=s.v)
    part = Window.partitionBy(s.key, "_part")
    x = (s.i + 1).cast("double")
    s = s.add(_slope=F.regr_slope(F.col("_y"), x).over(part), _base=F.regr_intercept(F.col("_y"), x).over(part), _sd=F.stddev_pop("_y").over(part), _first=F.min("_i").over(part))
    inside = F.col("_part") < F.col("_whole")
    line = F.col("_slope") * x + F.col("_base")
    return s.give(centerline=F.when(inside, line), upper_channel=F.when(inside, line + std_deviations * F.col("_sd")), lower_channel=F.when(inside, line - std_deviations * F.col("_sd"))).add(break_point=inside & (s.i == F.col("_first")))


@operator("VWAP", "Volume Weighted Average Price", CATEGORY, [Param("start_date", None, kind="date")], outputs=["vwap"], value="vwap", needs="bars")
def vwap(s: Stage, start_date=None) -> Stage:
    counts = F.lit(True) if start_date is None else F.col(s.ts) >= F.lit(start_date).cast(dict(s.df.dtypes)[s.ts])
    s = s.add(_pv=F.when(counts, F.col("volume") * (F.col("high") + F.col("low") + F.col("close")) / 3), _vol=F.when(counts, F.col("volume")))
    return s.give(vwap=F.when(counts, F.try_divide(F.sum("_pv").over(s.past), F.sum("_vol").over(s.past))))

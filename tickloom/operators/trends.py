"""Price trends, stops and reversals."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans.spec import Param, need, operator
from ..plans.stage import Stage
from .channels import HLC, atr_columns, end_type_of, fractal_columns
from .moving_averages import at_least, folded, periods
from .oscillators import true_high_low

CATEGORY = "PriceTrend"
STOPS = "StopAndReverse"


@operator("ADX", "Average Directional Index (ADX)", CATEGORY, [periods(14)], outputs=["pdi", "mdi", "dx", "adx", "adxr"], value="adx", needs="bars", tier="fold", check=at_least(2), warmup=lambda n, p: 2 * n + 100, warmup_on="pdi")
def adx(s: Stage, lookback_periods: int) -> Stage:
    return s.fold(HLC, ["pdi", "mdi", "dx", "adx", "adxr"], lambda: K.adx(lookback_periods))


def _alligator(jaw_periods: int, jaw_offset: int, teeth_periods: int, teeth_offset: int, lips_periods: int, lips_offset: int) -> None:
    need(jaw_periods > teeth_periods > lips_periods > 0, "jaw_periods > teeth_periods > lips_periods > 0")
    need(min(jaw_offset, teeth_offset, lips_offset) > 0, "offsets > 0")
    need(jaw_periods + jaw_offset > teeth_periods + teeth_offset > lips_periods + lips_offset, "periods and offsets together must fall from jaw to lips")


@operator("ALLIGATOR", "Williams Alligator", CATEGORY, [Param("jaw_periods", 13, 2, 250), Param("jaw_offset", 8, 1, 50), Param("teeth_periods", 8, 2, 250), Param("teeth_offset", 5, 1, 50), Param("lips_periods", 5, 2, 250), Param("lips_offset", 3, 1, 50)], outputs=["jaw", "teeth", "lips"], value=None, price="hl2", tier="fold", check=_alligator, warmup=lambda n, p: n + 251)
def alligator(s: Stage, jaw_periods: int, jaw_offset: int, teeth_periods: int, teeth_offset: int, lips_periods: int, lips_offset: int) -> Stage:
    return folded(s, ["_x"], ["jaw", "teeth", "lips"], K.alligator, ((jaw_periods, jaw_offset), (teeth_periods, teeth_offset), (lips_periods, lips_offset)))


@operator("AROON", "Aroon Up/Down", CATEGORY, [periods(25, 1)], outputs=["aroon_up", "aroon_down", "oscillator"], value="oscillator", needs="bars", check=at_least(1))
def aroon(s: Stage, lookback_periods: int) -> Stage:
    n = lookback_periods
    frame = s.last(n + 1)
    # of equal extremes the earliest counts
    top = -F.max(F.struct(F.col("high"), (-s.i).alias("k"))).over(frame)["k"]
    bottom = F.min(F.struct(F.col("low"), s.i.alias("k"))).over(frame)["k"]
    s = s.give(aroon_up=s.from_row(n, 100.0 * (n - (s.i - top)) / n), aroon_down=s.from_row(n, 100.0 * (n - (s.i - bottom)) / n))
    return s.give(oscillator=F.col("aroon_up") - F.col("aroon_down"))


def _multiple(lookback_periods: int, multiplier: float, **rest) -> None:
    need(lookback_periods > 1 and multiplier > 0, "lookback_periods > 1, multiplier > 0")


@operator("ATR-STOP", "ATR Trailing Stop", CATEGORY, [periods(21, 1, 50), Param("multiplier", 3.0, 0.1, 10.0, kind="double"), Param("end_type", "close", kind="EndType")], outputs=["atr_stop", "buy_stop", "sell_stop", "atr"], value="atr_stop", needs="bars", tier="fold", check=_multiple)
def atr_stop(s: Stage, lookback_periods: int, multiplier: float, end_type: str) -> Stage:
    by_range = end_type_of(end_type) == "high_low"
    return s.fold(HLC, ["atr_stop", "buy_stop", "sell_stop", "atr"], lambda: K.atr_stop(lookback_periods, multiplier, by_range))


@operator("SUPERTREND", "SuperTrend", CATEGORY, [periods(10, 1, 50), Param("multiplier", 3.0, 0.1, 10.0, kind="double")], outputs=["super_trend", "upper_band", "lower_band"], value="super_trend", needs="bars", tier="fold", check=_multiple)
def super_trend(s: Stage, lookback_periods: int, multiplier: float) -> Stage:
    return s.fold(HLC, ["super_trend", "upper_band", "lower_band"], lambda: K.super_trend(lookback_periods, multiplier))


@operator("ELDER-RAY", "Elder-ray Index", CATEGORY, [periods(13, 1)], outputs=["ema", "bull_power", "bear_power"], value="bull_power + bear_power", needs="bars", tier="fold", check=at_least(1), warmup=lambda n, p: n + 1 + 100, warmup_on="ema")
def elder_ray(s: Stage, lookback_periods: int) -> Stage:
    s = s.fold(["close"], ["ema"], lambda: K.ema(lookback_periods)).ready()
    return s.give(bull_power=F.col("high") - F.col("ema"), bear_power=F.col("low") - F.col("ema"))


def _ichimoku(tenkan_periods: int, kijun_periods: int, senkou_b_periods: int, senkou_offset: int | None, chikou_offset: int | None) -> None:
    need(tenkan_periods > 0 and kijun_periods > 0 and senkou_b_periods > kijun_periods, "periods > 0, senkou_b_periods > kijun_periods")
    need(min(senkou_offset or 0, chikou_offset or 0) >= 0, "offsets >= 0")


@operator("ICHIMOKU", "Ichimoku Cloud", CATEGORY, [Param("tenkan_periods", 9, 1, 250), Param("kijun_periods", 26, 2, 250), Param("senkou_b_periods", 52, 3, 250), Param("senkou_offset", None), Param("chikou_offset", None)], outputs=["tenkan_sen", "kijun_sen", "senkou_span_a", "senkou_span_b", "chikou_span"], value=None, needs="bars", check=_ichimoku, repaints=True)
def ichimoku(s: Stage, tenkan_periods: int, kijun_periods: int, senkou_b_periods: int, senkou_offset: int | None, chikou_offset: int | None) -> Stage:
    """Offsets are kijun_periods unless given; one given offset counts for both."""
    shift = kijun_periods if senkou_offset is None else senkou_offset
    back = shift if chikou_offset is None else chikou_offset

    def middle(n: int, late: int = 0) -> Column:
        frame = s.rows(1 - n - late, -late)
        return s.from_row(n + late - 1, (F.max("high").over(frame) + F.min("low").over(frame)) / 2)

    s = s.give(tenkan_sen=middle(tenkan_periods), kijun_sen=middle(kijun_periods), senkou_span_b=middle(senkou_b_periods, shift))
    s = s.add(_mid=(F.col("tenkan_sen") + F.col("kijun_sen")) / 2)
    first = max(2 * shift, tenkan_periods, kijun_periods) - 1
    return s.give(senkou_span_a=s.from_row(first, s.lag(F.col("_mid"), shift) if shift else F.col("_mid")), chikou_span=s.lead(F.col("close"), back) if back else F.col("close"))


def _macd(fast_periods: int, slow_periods: int, signal_periods: int) -> None:
    need(0 < fast_periods < slow_periods and signal_periods >= 0, "0 < fast_periods < slow_periods, signal_periods >= 0")


MACD_PARAMS = [Param("fast_periods", 12, 1, 200), Param("slow_periods", 26, 1, 250), Param("signal_periods", 9, 1, 50)]


@operator("MACD", "Moving Average Convergence/Divergence", CATEGORY, MACD_PARAMS, outputs=["macd", "signal", "histogram", "fast_ema", "slow_ema"], value="macd", tier="fold", check=_macd, warmup=lambda n, p: n + 2 + 250, warmup_on="signal")
def macd(s: Stage, fast_periods: int, slow_periods: int, signal_periods: int) -> Stage:
    return folded(s, ["_x"], ["macd", "signal", "histogram", "fast_ema", "slow_ema"], K.macd, fast_periods, slow_periods, signal_periods)


LEVELS = ["pp", "s1", "s2", "s3", "s4", "r1", "r2", "r3", "r4"]


def pivot_levels(kind: str, o: Column, h: Column, low: Column, c: Column) -> dict[str, Column]:
    """Support and resistance around the pivot of a window's open, high, low and close."""
    span = h - low
    none = F.lit(None).cast("double")
    out = dict.fromkeys(LEVELS, none)
    if kind in ("standard", "woodie"):
        pp = (h + low + c) / 3 if kind == "standard" else (h + low + 2 * o) / 4
        out |= {"pp": pp, "s1": 2 * pp - h, "s2": pp - span, "s3": low - 2 * (h - pp), "r1": 2 * pp - low, "r2": pp + span, "r3": h + 2 * (pp - low)}
    elif kind == "camarilla":
        out["pp"] = c
        for k, part in enumerate((12, 6, 4, 2), 1):
            out |= {f"s{k}": c - 1.1 / part * span, f"r{k}": c + 1.1 / part * span}
    elif kind == "fibonacci":
        out["pp"] = (h + low + c) / 3
        for k, part in enumerate((0.382, 0.618, 1.0), 1):
            out |= {f"s{k}": out["pp"] - part * span, f"r{k}": out["pp"] + part * span}
    elif kind == "demark":
        x = F.when(c < o, h + 2 * low + c).when(c > o, 2 * h + low + c).otherwise(h + low + 2 * c)
        out |= {"pp": x / 4, "s1": x / 2 - h, "r1": x / 2 - low}
    return out


POINT_TYPES = ("standard", "camarilla", "demark", "fibonacci", "woodie")


def _point_type(value: str) -> str:
    need(str(value).lower() in POINT_TYPES, f"point_type is one of {POINT_TYPES}")
    return str(value).lower()


def window_number(ts: Column, size: str) -> Column:
    """Calendar number of a month, week (from Sunday, January 1 in week 1), day or hour."""
    if size == "week":
        first = F.dayofweek(F.date_trunc("year", ts))
        return F.floor((F.dayofyear(ts) - 1 + first - 1) / 7) + 1
    return {"month": F.month, "day": F.dayofmonth, "hour": F.hour}[size](ts)


def _pivot_points(window_size: str, point_type: str) -> None:
    need(str(window_size).lower() in ("month", "week", "day", "hour"), "window_size is month, week, day or hour")
    _point_type(point_type)


@operator("PIVOT-POINTS", "Pivot Points", CATEGORY, [Param("window_size", "month", kind="BarInterval"), Param("point_type", "standard", kind="PivotPointType")], outputs=LEVELS, value="pp", needs="bars", check=_pivot_points)
def pivot_points(s: Stage, window_size: str, point_type: str) -> Stage:
    kind = _point_type(point_type)
    s = s.add(_number=window_number(F.col(s.ts), str(window_size).lower()))
    s = s.add(_new=F.coalesce((F.col("_number") != s.lag(F.col("_number"))).cast("int"), F.lit(0)))
    s = s.add(_window=F.sum("_new").over(s.past))
    # each window's own values, handed to the rows of the next one
    own = Window.partitionBy(s.key, "_window").orderBy(s.ts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.add(_o=F.first("open").over(own), _h=F.max("high").over(own), _l=F.min("low").over(own), _c=F.last("close").over(own))
    before = {x: F.last(F.when(F.col("_new") == 1, s.lag(F.col(x))), ignorenulls=True) for x in ("_o", "_h", "_l", "_c")}
    s = s.add(**{f"_lag{x}": F.when(F.col("_new") == 1, s.lag(F.col(x))) for x in before})
    s = s.add(**{f"_prev{x}": F.last(F.col(f"_lag{x}"), ignorenulls=True).over(s.past) for x in before})
    o = F.col("_o") if kind == "woodie" else F.col("_prev_o")
    levels = pivot_levels(kind, o, F.col("_prev_h"), F.col("_prev_l"), F.col("_prev_c"))
    return s.give(**{k: F.when(F.col("_window") > 0, c) for k, c in levels.items()})


def _rolling(window_periods: int, offset_periods: int, point_type: str) -> None:
    need(window_periods > 0 and offset_periods >= 0, "window_periods > 0, offset_periods >= 0")
    _point_type(point_type)


@operator("ROLLING-PIVOTS", "Rolling Pivots", CATEGORY, [Param("window_periods", 20, 1, 250), Param("offset_periods", 0, 0, 100), Param("point_type", "standard", kind="PivotPointType")], outputs=LEVELS, value="pp", needs="bars", check=_rolling)
def rolling_pivots(s: Stage, window_periods: int, offset_periods: int, point_type: str) -> Stage:
    n, late = window_periods, offset_periods
    frame = s.rows(-(n + late), -(late + 1))
    s = s.add(_h=F.max("high").over(frame), _l=F.min("low").over(frame), _c=s.lag(F.col("close"), late + 1))
    levels = pivot_levels(_point_type(point_type), F.col("open"), F.col("_h"), F.col("_l"), F.col("_c"))
    return s.give(**{k: s.from_row(n + late, c) for k, c in levels.items()})


def _pivots(left_span: int, right_span: int, max_trend_periods: int, end_type: str) -> None:
    need(min(left_span, right_span) >= 2 and max_trend_periods > left_span, "spans >= 2, max_trend_periods > left_span")
    end_type_of(end_type)


def _trend(s: Stage, point: str, name: str, longest: int, up: str, down: str) -> Stage:
    """Lines between a point and the next one, if that is near and not equal."""
    p = F.col(point)
    s = s.add(_at=F.when(p.isNotNull(), s.i))
    following = s.rows(1, longest)  # no line goes further
    s = s.add(
        _a=F.last(p, ignorenulls=True).over(s.past),
        _ai=F.last("_at", ignorenulls=True).over(s.past),
        _pa=F.last(p, ignorenulls=True).over(s.rows(Window.unboundedPreceding, -1)),
        _pi=F.last("_at", ignorenulls=True).over(s.rows(Window.unboundedPreceding, -1)),
        _b=F.first(p, ignorenulls=True).over(following),
        _bi=F.first("_at", ignorenulls=True).over(following),
    )
    drawn = lambda a, ai, b, bi: (bi - ai <= longest) & (a != b)
    step = lambda a, ai, b, bi: (b - a) / (bi - ai)
    # on a point the line to it comes first; a point without one starts the next
    to_here = (s.i == F.col("_ai")) & drawn(F.col("_pa"), F.col("_pi"), F.col("_a"), F.col("_ai"))
    ahead = drawn(F.col("_a"), F.col("_ai"), F.col("_b"), F.col("_bi"))
    line = F.when(to_here, F.col("_a")).when(ahead, F.col("_a") + step(F.col("_a"), F.col("_ai"), F.col("_b"), F.col("_bi")) * (s.i - F.col("_ai")))
    trend = F.when(to_here, F.when(F.col("_a") > F.col("_pa"), up).otherwise(down)).when(ahead & (s.i > F.col("_ai")), F.when(F.col("_b") > F.col("_a"), up).otherwise(down))
    return s.give(**{f"{name}_line": line}).add(**{f"{name}_trend": trend})


@operator("PIVOTS", "Pivots", CATEGORY, [Param("left_span", 2, 2, 100), Param("right_span", 2, 2, 100), Param("max_trend_periods", 20, 2, 1000), Param("end_type", "high_low", kind="EndType")], outputs=["high_point", "low_point", "high_line", "low_line", "high_trend", "low_trend"], value=None, needs="bars", tier="whole", check=_pivots, repaints=True)
def pivots(s: Stage, left_span: int, right_span: int, max_trend_periods: int, end_type: str) -> Stage:
    s = fractal_columns(s, left_span, right_span, end_type_of(end_type))
    s = s.add(high_point=F.col("_bear"), low_point=F.col("_bull"))
    s = _trend(s, "high_point", "high", max_trend_periods, "hh", "lh")
    return _trend(s, "low_point", "low", max_trend_periods, "hl", "ll")


def _roc_wb(lookback_periods: int, ema_periods: int, std_dev_periods: int) -> None:
    need(lookback_periods > 0 and ema_periods > 0 and 0 < std_dev_periods <= lookback_periods, "periods > 0, std_dev_periods <= lookback_periods")


@operator("ROC-WB", "ROC with Bands", CATEGORY, [periods(20, 1), Param("ema_periods", 5, 1, 100), Param("std_dev_periods", 5, 1, 100)], outputs=["roc", "roc_ema", "upper_band", "lower_band"], value="roc", tier="fold", check=_roc_wb, warmup=lambda n, p: n + 1 + 100, warmup_on="roc_ema")
def roc_wb(s: Stage, lookback_periods: int, ema_periods: int, std_dev_periods: int) -> Stage:
    s = s.add(_y=s.v)
    s = s.add(_back=s.lag(F.col("_y"), lookback_periods))
    s = s.give(roc=100 * F.try_divide(F.col("_y") - F.col("_back"), F.col("_back")))
    square = F.coalesce(F.col("roc") * F.col("roc"), F.lit(float("nan")))
    band = F.when(s.i >= std_dev_periods, F.sqrt(F.avg(square).over(s.last(std_dev_periods))))
    s = s.give(upper_band=band, lower_band=-band)
    return s.fold(["roc"], ["roc_ema"], lambda: _late_ema(ema_periods))


def _late_ema(n: int) -> K.Step:
    smooth = K.Smooth(n, first=n)
    return K.with_many(lambda i, x: (smooth.push(i, x),), lambda i, x: (smooth.push_many(i, x),))


@operator("VORTEX", "Vortex Indicator", CATEGORY, [periods(14, 2, 100)], outputs=["pvi", "nvi"], value=None, needs="bars", check=at_least(2))
def vortex(s: Stage, lookback_periods: int) -> Stage:
    n = lookback_periods
    s = true_high_low(s)
    s = s.add(_up=F.abs(F.col("high") - s.lag(F.col("low"))), _down=F.abs(F.col("low") - s.lag(F.col("high"))))
    total = F.sum("_tr").over(s.last(n))
    return s.give(pvi=s.from_row(n, F.try_divide(F.sum("_up").over(s.last(n)), total)), nvi=s.from_row(n, F.try_divide(F.sum("_down").over(s.last(n)), total)))


def _chandelier(lookback_periods: int, multiplier: float, type: str) -> None:
    need(lookback_periods > 1 and multiplier > 0, "lookback_periods > 1, multiplier > 0")
    need(str(type).lower() in ("long", "short"), "type is long or short")


@operator("CHEXIT", "Chandelier Exit", STOPS, [periods(22, 1), Param("multiplier", 3.0, 1.0, 10.0, kind="double"), Param("type", "long", kind="Direction")], outputs=["chandelier_exit"], value="chandelier_exit", needs="bars", tier="fold", check=_chandelier)
def chandelier(s: Stage, lookback_periods: int, multiplier: float, type: str) -> Stage:
    n = lookback_periods
    s = atr_columns(s.add(_top=F.max("high").over(s.last(n)), _bottom=F.min("low").over(s.last(n))), n).ready()
    exit_ = F.col("_top") - F.col("_atr") * multiplier if str(type).lower() == "long" else F.col("_bottom") + F.col("_atr") * multiplier
    return s.give(chandelier_exit=s.from_row(n, exit_))


def _sar(acceleration_step: float, max_acceleration_factor: float, initial_factor: float | None) -> None:
    need(0 < acceleration_step <= max_acceleration_factor, "0 < acceleration_step <= max_acceleration_factor")
    need(initial_factor is None or 0 < initial_factor <= max_acceleration_factor, "0 < initial_factor <= max_acceleration_factor")


@operator("PSAR", "Parabolic SAR", STOPS, [Param("acceleration_step", 0.02, 0.01, 0.1, kind="double"), Param("max_acceleration_factor", 0.2, 0.1, 1.0, kind="double"), Param("initial_factor", None, kind="double")], outputs=["sar", "is_reversal"], value="sar", needs="bars", tier="fold", check=_sar, repaints=True)
def parabolic_sar(s: Stage, acceleration_step: float, max_acceleration_factor: float, initial_factor: float | None) -> Stage:
    initial = acceleration_step if initial_factor is None else initial_factor
    s = s.fold(["high", "low"], {"_sar": "double", "_turn": "boolean"}, lambda: K.parabolic_sar(acceleration_step, max_acceleration_factor, initial)).ready()
    turned = F.coalesce(F.max(F.col("_turn").cast("int")).over(s.rows(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    return s.add(sar=F.when(turned, F.col("_sar")), is_reversal=F.when(turned, F.col("_turn")))


@operator("VOL-STOP", "Volatility Stop", STOPS, [periods(7, 1, 50), Param("multiplier", 3.0, 0.1, 10.0, kind="double")], outputs=["sar", "is_stop", "upper_band", "lower_band"], value="sar", needs="bars", tier="fold", check=_multiple, warmup=lambda n, p: max(100, n), repaints=True)
def volatility_stop(s: Stage, lookback_periods: int, multiplier: float) -> Stage:
    s = s.fold(HLC, {"_sar": "double", "_stop": "boolean", "_upper": "double", "_lower": "double"}, lambda: K.volatility_stop(lookback_periods, multiplier)).ready()
    # what comes up to the first stop is masked, but nothing if there is no stop at all
    s = s.summed(_until=F.min(F.when(F.col("_stop"), F.col("_i"))))
    shown = F.col("_until").isNull() | (s.i > F.col("_until"))
    return s.add(sar=F.when(shown, F.col("_sar")), is_stop=F.when(shown, F.col("_stop")), upper_band=F.when(shown, F.col("_upper")), lower_band=F.when(shown, F.col("_lower")))

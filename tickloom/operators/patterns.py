"""Patterns and transforms of prices."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..plans.spec import Param, need, operator
from ..plans.stage import Stage
from .channels import HLC, end_type_of, fractal_columns
from .moving_averages import at_least, folded, periods

TRANSFORM, CANDLES, PATTERN = "PriceTransform", "CandlestickPattern", "PricePattern"
#: What a match of a candle pattern is worth.
BULL_SIGNAL, NEUTRAL, NONE, BEAR_SIGNAL = 100, 1, 0, -100


def candle_columns() -> dict:
    """Size and parts of a candle; a flat one has shares of 1."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    size, body = h - low, F.abs(o - c)
    upper, lower = h - F.greatest(o, c), F.least(o, c) - low
    share = lambda x: F.when(size == 0, 1.0).otherwise(F.try_divide(x, size))
    return {"size": size, "body": body, "upper_wick": upper, "lower_wick": lower, "body_pct": share(body), "upper_wick_pct": share(upper), "lower_wick_pct": share(lower), "is_bullish": c > o, "is_bearish": c < o}


@operator("DOJI", "Doji", CANDLES, [Param("max_price_change_percent", 0.1, 0.0, 0.5, kind="double")], outputs=["price", "match"], value="price", needs="bars", check=lambda max_price_change_percent: need(0 <= max_price_change_percent <= 0.5, "0 <= max_price_change_percent <= 0.5"))
def doji(s: Stage, max_price_change_percent: float) -> Stage:
    found = F.coalesce(F.abs(F.try_divide(F.col("close"), F.col("open")) - 1) <= max_price_change_percent / 100, F.lit(False))
    return s.add(price=F.when(found, F.col("close")), match=F.when(found, NEUTRAL).otherwise(NONE))


@operator("MARUBOZU", "Marubozu", CANDLES, [Param("min_body_percent", 95.0, 80.0, 100.0, kind="double")], outputs=["price", "match"], value="price", needs="bars", check=lambda min_body_percent: need(80 <= min_body_percent <= 100, "80 <= min_body_percent <= 100"))
def marubozu(s: Stage, min_body_percent: float) -> Stage:
    found = candle_columns()["body_pct"] >= min_body_percent / 100
    return s.add(price=F.when(found, F.col("close")), match=F.when(found & (F.col("close") > F.col("open")), BULL_SIGNAL).when(found, BEAR_SIGNAL).otherwise(NONE))


def _fractal(window_span: int, end_type: str, right_span: int | None) -> None:
    need(min(window_span, right_span or window_span) >= 2, "spans >= 2")
    end_type_of(end_type)


@operator("FRACTAL", "Williams Fractal (high/low)", PATTERN, [Param("window_span", 2, 1, 100), Param("end_type", "high_low", kind="EndType"), Param("right_span", None)], outputs=["fractal_bear", "fractal_bull"], value=None, needs="bars", check=_fractal, repaints=True)
def fractal(s: Stage, window_span: int, end_type: str, right_span: int | None) -> Stage:
    s = fractal_columns(s, window_span, right_span or window_span, end_type_of(end_type))
    return s.give(fractal_bear=F.col("_bear"), fractal_bull=F.col("_bull"))


@operator("FISHER", "Ehlers Fisher Transform", TRANSFORM, [periods(10, 1)], outputs=["fisher", "trigger"], value="fisher", price="hl2", tier="fold", check=at_least(1))
def fisher_transform(s: Stage, lookback_periods: int) -> Stage:
    return folded(s, ["_x"], ["fisher", "trigger"], K.fisher, lookback_periods)


@operator("HEIKINASHI", "HeikinAshi", TRANSFORM, outputs=["ha_open", "ha_high", "ha_low", "ha_close", "ha_volume"], value="ha_close", needs="bars", tier="fold")
def heikin_ashi(s: Stage) -> Stage:
    return s.fold(["open", *HLC, "volume"], ["ha_open", "ha_high", "ha_low", "ha_close", "ha_volume"], K.heikin_ashi)


# ---------------------------------------------------------------- rows that differ from the bars

BRICKS = "brick_no long, open double, high double, low double, close double, volume double, is_up boolean"


def exact(x: float) -> Decimal:
    """The decimal that a float shows."""
    return Decimal(repr(float(x)))


class Bricks:
    """Renko bricks of one series, row by row."""

    def __init__(self, size: Decimal, by_range: bool):
        self.size, self.by_range = size, by_range
        self.open = self.close = None
        self.made = 0
        self._clear()

    def _clear(self) -> None:
        self.high, self.low, self.volume = None, None, Decimal(0)

    def push(self, high: float, low: float, close: float, volume: float) -> list[tuple]:
        h, lo, c = exact(high), exact(low), exact(close)
        if self.close is None:
            places = max(max(0, -self.size.normalize().as_tuple().exponent) - 1, 0)
            self.open = self.close = c.quantize(Decimal(1).scaleb(-places), ROUND_HALF_EVEN)
            return []
        self.high = h if self.high is None else max(self.high, h)
        self.low = lo if self.low is None else min(self.low, lo)
        self.volume += exact(volume)
        top, bottom = max(self.open, self.close), min(self.open, self.close)
        if self.by_range:
            up, down = (h - top) / self.size, (bottom - lo) / self.size
            count = int(up if up >= down else -down)
        else:
            count = int((c - top) / self.size) if c > top else int((c - bottom) / self.size) if c < bottom else 0
        out = []
        for _ in range(abs(count)):
            start = max(self.open, self.close) if count > 0 else min(self.open, self.close)
            self.open, self.close = start, start + self.size if count > 0 else start - self.size
            out.append((self.made, float(self.open), float(self.high), float(self.low), float(self.close), float(self.volume / abs(count)), count > 0))
            self.made += 1
        if count:
            self._clear()
        return out


def _brick_rows(s: Stage, size_of, by_range: bool, inputs: list[str]) -> Stage:
    """The bricks of each series as rows of their own; size_of gives a series' brick from its first row, or None."""
    key, ts = s.key, s.ts
    df = s.df.select(key, ts, "_i", *inputs)
    kinds = {f.name: f for f in df.schema.fields}
    schema = T.StructType([kinds[key], kinds[ts], *T._parse_datatype_string(BRICKS).fields])
    names = [f.name for f in schema.fields]
    types = [pa.int64(), *[pa.float64()] * 5, pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bricks = None
        for batch in batches:
            rows = batch.to_pydict()
            at, made = [], []
            for k in range(batch.num_rows):
                if bricks is None:
                    size = size_of({x: rows[x][k] for x in inputs})
                    if size is None:
                        return
                    bricks = Bricks(size, by_range)
                values = [rows[x][k] for x in ("high", "low", "close", "volume")]
                if None in values:
                    continue
                new = bricks.push(*values)
                made += new
                at += [k] * len(new)
            if made:
                where = pa.array(at, pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), *columns], names=names)

    return Stage(df.groupBy(key).applyInArrow(run, schema), key, ts, "close")


OHLCV = ["open", "high", "low", "close", "volume"]
BRICK_OUTPUTS = ["brick_no", *OHLCV, "is_up"]


@operator("RENKO", "Renko Chart", TRANSFORM, [Param("brick_size", low=0.001, high=1000000.0, shown=1.0, kind="double"), Param("end_type", "close", kind="EndType")], outputs=BRICK_OUTPUTS, value="close", needs="bars", tier="fold", check=lambda brick_size, end_type: need(brick_size > 0 and bool(end_type_of(end_type)), "brick_size > 0"), reshapes=True)
def renko(s: Stage, brick_size: float, end_type: str) -> Stage:
    size = exact(brick_size)
    return _brick_rows(s, lambda row: size, end_type_of(end_type) == "high_low", HLC + ["volume"])


@operator("RENKO-ATR", "Renko (ATR)", "PriceTrend", [Param("atr_periods", 14, 1, 100), Param("end_type", "close", kind="EndType")], outputs=BRICK_OUTPUTS, value="close", needs="bars", tier="whole", styles=["series"], check=lambda atr_periods, end_type: need(atr_periods > 1 and bool(end_type_of(end_type)), "atr_periods > 1"), repaints=True, reshapes=True)
def renko_atr(s: Stage, atr_periods: int, end_type: str) -> Stage:
    """Bricks as large as the last average range of the series; none if that is missing or zero."""
    s = s.fold(HLC, ["_tr", "_atr", "_atrp"], lambda: K.atr(atr_periods)).ready()
    s = s.summed(_size=F.max_by("_atr", s.ts))
    return _brick_rows(s, lambda row: exact(row["_size"]) if row["_size"] else None, end_type_of(end_type) == "high_low", [*HLC, "volume", "_size"])


class Swings:
    """Swings of one series, row by row, a row given out once no later one can change it.

    A leg runs from its turning point to the most extreme price since; once prices come back
    from there by the limit, that extreme is the next turning point and a new leg begins at
    it, for which the rows since count from the start. Rows are held from the last but one
    turning point on: lines between two points of one kind reach back that far.
    """

    def __init__(self, limit: Decimal):
        self.limit = limit
        self.base = 0  # number of the first row held
        self.rows: list[tuple[Decimal, Decimal, Decimal]] = []
        self.out: list[list] = []
        self.legs: list[tuple[int, Decimal, bool | None]] = []  # the open leg's start: row, price, whether it rises
        self.extreme: tuple[int, Decimal] = (0, Decimal(0))
        self.next = 0  # the row that the open leg looks at next
        self.last: dict[bool, tuple[int, Decimal]] = {}  # the last high (True) and low

    def push(self, high: float, low: float, close: float) -> list[tuple]:
        self.rows.append((exact(high), exact(low), exact(close)))
        self.out.append([None, None, None, None])
        if len(self.rows) == 1 and not self.base:
            self.first = self.rows[0]
            self.last = {True: (0, self.first[0]), False: (0, self.first[1])}
        if not self.legs:
            self._begin()
        if self.legs:
            self._follow()
        return self._settled()

    def finish(self) -> list[tuple]:
        """The rows that are left: the open leg ends at the last row."""
        end = self.base + len(self.rows) - 1
        if not self.legs and end > 0:
            self._start((0, self.first[2], None))
            self._follow()
        if self.legs and self.legs[-1][0] < end:
            high, low, _ = self.rows[end - self.base]
            self._draw(end, high if self.legs[-1][2] else low, None)
        return self._given(len(self.rows))

    def _begin(self) -> None:
        """The first move of the limit away from the first row, the larger one of two, tells which way the first leg runs."""
        high, low, _ = self.rows[-1]
        top, bottom = self.first[:2]
        if not top or not bottom:
            return
        up, down = (high - bottom) / bottom, (top - low) / top
        if max(up, down) >= self.limit and up != down:
            self._start((0, bottom, True) if up > down else (0, top, False))

    def _start(self, leg: tuple[int, Decimal, bool | None]) -> None:
        self.legs = [leg]
        self.extreme, self.next = leg[:2], leg[0] + 1

    def _follow(self) -> None:
        """Take the open leg, and those that it gives way to, up to the newest row."""
        while self.next < self.base + len(self.rows):
            rises = bool(self.legs[-1][2])
            high, low, _ = self.rows[self.next - self.base]
            price, back = (high, low) if rises else (low, high)
            at, best = self.extreme
            if price >= best if rises else price <= best:
                self.extreme = (self.next, price)
            elif best and abs(best - back) / best >= self.limit and (back < best) == rises:
                self._draw(at, best, rises)
                self._start((at, best, not rises))
                continue
            self.next += 1

    def _draw(self, at: int, price: Decimal, kind: bool | None) -> None:
        """The open leg ends at a point: its line, and the line from the last point of the same side."""
        start, value, rises = self.legs[-1]
        if at > start:
            step = (price - value) / (at - start)
            for i in range(start + 1 if start else at, at + 1):
                self.out[i - self.base][0] = float(value + step * (i - start))
            self.out[at - self.base][1] = None if kind is None else "H" if kind else "L"
        if rises is None:
            return
        before, was = self.last[rises]
        self.last[rises] = (at, price)
        if before and at != before:
            step = (price - was) / (at - before)
            for i in range(before, at + 1):
                self.out[i - self.base][2 if rises else 3] = float(was + step * (i - before))

    def _settled(self) -> list[tuple]:
        """Rows before the last points of both sides and before the open leg can change no more."""
        if not self.legs:
            return []
        return self._given(min(self.legs[-1][0], *(at for at, _ in self.last.values())) - self.base)

    def _given(self, n: int) -> list[tuple]:
        if n <= 0:
            return []
        made = [tuple(x) for x in self.out[:n]]
        self.base += n
        del self.rows[:n], self.out[:n]
        return made


@operator("ZIGZAG", "Zig Zag", TRANSFORM, [Param("end_type", "close", kind="EndType"), Param("percent_change", 5.0, 1.0, 200.0, kind="double")], outputs=["zig_zag", "point_type", "retrace_high", "retrace_low"], value="zig_zag", needs="bars", tier="whole", styles=["series"], check=lambda end_type, percent_change: need(percent_change > 0 and bool(end_type_of(end_type)), "percent_change > 0"), repaints=True)
def zig_zag(s: Stage, end_type: str, percent_change: float) -> Stage:
    """Swings of a series, read as a stream of which the rows since the last turning points are held."""
    by_range = end_type_of(end_type) == "high_low"
    added = T._parse_datatype_string("zig_zag double, point_type string, retrace_high double, retrace_low double").fields
    types = [pa.float64(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swings, held = Swings(exact(percent_change) / 100), None

        def given(made: list[tuple], table: pa.Table) -> Iterator[pa.RecordBatch]:
            if made:
                ready = table.slice(0, len(made))
                for k, (f, t) in enumerate(zip(added, types, strict=True)):
                    ready = ready.append_column(f.name, pa.array([m[k] for m in made], t))
                yield from ready.combine_chunks().to_batches()

        for batch in batches:
            at = batch.schema.get_field_index
            high, low, close = (batch.column(at(x)).to_pylist() for x in (HLC if by_range else ["close"] * 3))
            made = [m for row in zip(high, low, close, strict=True) for m in swings.push(*row)]
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own])
            yield from given(made, held)
            held = held.slice(len(made))
        if held is not None:
            yield from given(swings.finish(), held)

    schema = T.StructType([*s.df.schema.fields, *added])
    return Stage(s.df.groupBy(s.key).applyInArrow(run, schema), s.key, s.ts, s.x)


@operator("BARPART", "Bar Part", TRANSFORM, [Param("candle_part", "close", kind="CandlePart")], outputs=["value"], value="value", needs="bars")
def bar_part(s: Stage, candle_part: str) -> Stage:
    """One price of each bar."""
    from ..plans.series import part

    return s.add(value=part(str(candle_part).replace("_", "")).cast("double"))

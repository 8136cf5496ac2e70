"""Streams of trade ticks, or of bars, as larger bars."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.series import OHLCV
from ..plans.spec import need
from ..sources.bars import _ANCHOR, seconds_of


def stream_bars(ticks: DataFrame, interval: str | int, lateness: str = "1 hour", execution_id: str | None = "execution_id", order: list[str] | None = None) -> DataFrame:
    """Bars of a stream of (series_key, ts, price, volume), growing until the watermark passes them.

    In update mode each batch shows the bars that it has changed, the unfinished one
    included; in append mode a bar comes once, when it can no longer change. A repeated
    execution id counts once within `lateness`; later ticks than that are dropped. order:
    columns that settle which of equal times comes first.
    """
    seconds = seconds_of(interval)
    need(seconds > 0, "a month has no fixed length")
    if execution_id:
        # no event time is part of the key: one id may come again at any time within the lateness
        ticks = ticks.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["series_key", execution_id])
    else:
        ticks = ticks.withWatermark("ts", lateness)
    window = F.window("ts", f"{seconds} seconds", f"{seconds} seconds", f"{_ANCHOR % seconds} seconds")
    price, place = F.col("price").cast("double"), F.struct("ts", *(order or []))
    grouped = ticks.groupBy(F.col("series_key"), window).agg(F.min_by(price, place).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, place).alias("close"), F.sum(F.col("volume").cast("double")).alias("volume"))
    return grouped.select("series_key", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


#: Which of a bar's own numbers its open, high, low, close and volume come from; a tick has a price and a volume.
_BAR, _TICK = (0, 1, 2, 3, 4), (0, 0, 0, 0, 1)
_CODEC = "zstd"


def _none(kind: Any = np.int64) -> Any:
    return field(default_factory=lambda: np.empty(0, kind))


@dataclass
class Buckets:
    """The bars of one series that can still change, and the ticks (or smaller bars) they are made of.

    Ticks lie column by column, by time, order and arrival: one costs its bytes and no
    object. shown and bars: times and numbers of the bars that have been given, those
    between two others included.
    """

    use: tuple[int, ...] = _BAR
    at: np.ndarray = _none()
    #: Null for a tick that stands for itself.
    ids: pa.Array = field(default_factory=lambda: pa.array([], pa.string()))
    order: list[pa.Array] = field(default_factory=list)
    numbers: list[np.ndarray] = field(default_factory=list)
    #: The buckets that hold a tick.
    parts: np.ndarray = _none()
    shown: np.ndarray = _none()
    bars: np.ndarray = field(default_factory=lambda: np.empty((0, 5)))
    #: The end of what is pruned, and the last close before it.
    pruned: int | None = None
    close: float | None = None

    def take(self, rows: list[tuple[Any, int, str, tuple]], step: int, fill: bool, most: int | None) -> list[tuple[int, str, tuple | None]]:
        """rows of (identity or None, time, op, numbers) -> (bucket, kind, bar) of the bars that they change."""
        ids = pa.array([None if r[0] is None else r[0][0] for r in rows], pa.string())
        numbers = [np.array([r[3][k] for r in rows], float) for k in range(max(self.use) + 1)]
        times, bars, gone = self.take_columns(ids, np.array([r[1] for r in rows], np.int64), np.array([r[2] == "delete" for r in rows], bool), [], numbers, step, fill, most)
        return [(t, "upsert", tuple(bar)) for t, bar in zip(times.tolist(), bars.tolist(), strict=True)] + [(t, "delete", None) for t in gone.tolist()]

    def take_columns(self, ids: pa.Array, at: np.ndarray, gone: np.ndarray, order: list[pa.Array], numbers: list[np.ndarray], step: int, fill: bool, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows in order of arrival -> the times and numbers of the bars that they change, and the times of bars that are no more."""
        coded = ids.dictionary_encode()
        code = coded.indices.fill_null(-1).to_numpy()
        named = code >= 0
        last = np.empty(len(coded.dictionary), np.int64)
        last[code[named]] = np.flatnonzero(named)
        new = ~named
        new[last] = True  # of rows with one identity the last counts
        new &= ~gone
        if self.pruned is not None:
            new &= at - (at - _ANCHOR * 1_000_000) % step >= self.pruned
        stays = ~pc.is_in(self.ids, value_set=coded.dictionary).to_numpy(zero_copy_only=False)  # a correction: what came before is no more
        if stays.all() and not new.any():
            return self.shown[:0], self.bars[:0], self.shown[:0]
        self._merge(stays, new, ids, at, order, numbers)
        times, bars = self._all(step, fill)
        place = np.searchsorted(self.shown, times)
        known = place < len(self.shown)
        known[known] = self.shown[place[known]] == times[known]
        was, now = self.bars[place[known]], bars[known]
        changed = ~known
        changed[known] = ~((was == now) | np.isnan(was) & np.isnan(now)).all(axis=1)
        out = times[changed], bars[changed], self.shown[~np.isin(self.shown, times)]
        self.shown, self.bars = times, bars
        if most is not None and len(self.parts) > most:
            self._prune(step, most)
        return out

    def dumped(self) -> tuple[int, bytes]:
        """Length and compressed bytes: the JVM holds several copies of a state."""
        whole = pickle.dumps(self, pickle.HIGHEST_PROTOCOL)
        return len(whole), pa.compress(whole, codec=_CODEC, asbytes=True)

    @staticmethod
    def loaded(size: int, data: bytes) -> Buckets:
        return pickle.loads(pa.decompress(data, size, codec=_CODEC))

    def _merge(self, stays: np.ndarray, new: np.ndarray, ids: pa.Array, at: np.ndarray, order: list[pa.Array], numbers: list[np.ndarray]) -> None:
        held = self.order or [x.slice(0, 0) for x in order]
        before = self.numbers or [x[:0] for x in numbers]
        self.at = np.concatenate([self.at[stays], at[new]])
        both = [pa.concat_arrays([x.filter(pa.array(stays)), y.filter(pa.array(new))]) for x, y in zip((self.ids, *held), (ids, *order), strict=True)]
        # equal times: by the order columns, else those that came first; the sort is stable
        ranks = [x.to_numpy() if pa.types.is_integer(x.type) else pc.rank(x, tiebreaker="dense", null_placement="at_start").to_numpy() for x in both[1:]]
        by = np.lexsort((*reversed(ranks), self.at))
        self.at = self.at[by]
        self.ids, *self.order = (x.take(pa.array(by)) for x in both)
        self.numbers = [np.concatenate([x[stays], y[new]])[by] for x, y in zip(before, numbers, strict=True)]

    def _all(self, step: int, fill: bool) -> tuple[np.ndarray, np.ndarray]:
        """Times and numbers of all bars from the ticks."""
        bucket = self.at - (self.at - _ANCHOR * 1_000_000) % step
        first = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1))
        self.parts = times = bucket[first]
        if not len(first):
            return times, np.empty((0, 5))
        final = np.append(first[1:], len(bucket)) - 1
        o, h, l, c, v = (self.numbers[k] for k in self.use)
        bars = np.column_stack([o[first], np.fmax.reduceat(h, first), np.fmin.reduceat(l, first), c[final], np.add.reduceat(v, first)])
        if not fill:
            return times, bars
        # as many rows for each bar as there are empty ones before it, and one
        count = np.diff(times, prepend=times[0] - step if self.pruned is None else self.pruned - step) // step
        of = np.repeat(np.arange(len(times)), count)
        left = np.cumsum(count)[of] - 1 - np.arange(len(of))
        all_bars, empty = bars[of], left > 0
        closes = np.append(np.nan if self.close is None else self.close, bars[:-1, 3])
        all_bars[empty, :4] = closes[of[empty], None]
        all_bars[empty, 4] = 0.0
        return times[of] - step * left, all_bars

    def _prune(self, step: int, most: int) -> None:
        before = int(self.parts[-most - 1])
        self.close = float(self.bars[np.searchsorted(self.shown, before), 3])
        self.pruned = before + step
        k = int(np.searchsorted(self.at, self.pruned))
        # copies, or the state would hold what is pruned
        self.at, self.numbers = self.at[k:].copy(), [x[k:].copy() for x in self.numbers]
        rest = pa.array(np.arange(k, len(self.ids)))
        self.ids, self.order = self.ids.take(rest), [x.take(rest) for x in self.order]
        k = int(np.searchsorted(self.shown, self.pruned))
        self.shown, self.bars, self.parts = self.shown[k:].copy(), self.bars[k:].copy(), self.parts[-most:].copy()


def _aggregated(rows: DataFrame, use: tuple[int, ...], interval: str | int, fill_gaps: bool, max_buckets: int | None) -> DataFrame:
    """rows: series_key, ts, identity, gone, then the numbers (n0, ...) and the columns of the order (o0, ...)."""
    seconds = seconds_of(interval)
    need(seconds > 0, "a month has no fixed length")
    need(max_buckets is None or max_buckets >= 2, "at least two bars must be kept")
    kinds = {f.name: pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in rows.schema.fields if f.name.startswith("o")}
    names = [f"n{k}" for k in range(max(use) + 1)]

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Buckets.loaded(*state.get) if state.exists else Buckets(use)
        frame = pd.concat(list(parts), ignore_index=True)
        at = frame["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        ids = pa.array(frame["identity"], pa.string(), from_pandas=True)
        by = pc.sort_indices(pa.table({"at": at, "id": ids, "row": np.arange(len(at))}), [("at", "ascending"), ("id", "ascending"), ("row", "ascending")])
        place = by.to_numpy()
        order = [pa.array(frame[x], kind, from_pandas=True).take(by) for x, kind in kinds.items()]
        times, bars, dropped = held.take_columns(ids.take(by), at[place], frame["gone"].to_numpy(bool)[place], order, [frame[x].to_numpy(float)[place] for x in names], seconds * 1_000_000, fill_gaps, max_buckets)
        state.update(held.dumped())
        if len(times) + len(dropped):
            bars = np.vstack([bars, np.full((len(dropped), 5), np.nan)])
            kind = ["upsert"] * len(times) + ["delete"] * len(dropped)
            yield pd.DataFrame({"series_key": key[0], "ts": pd.to_datetime(np.append(times, dropped), unit="us"), **{c: bars[:, k] for k, c in enumerate(OHLCV)}, "kind": kind})

    schema = "series_key string, ts timestamp_ntz, open double, high double, low double, close double, volume double, kind string"
    return rows.groupBy("series_key").applyInPandasWithState(update, schema, "size long, state binary", "update", GroupStateTimeout.NoTimeout)


def _gone(df: DataFrame) -> Column:
    return F.coalesce(F.col("op") == "delete", F.lit(False)) if "op" in df.columns else F.lit(False)


def stream_resample(bars: DataFrame, interval: str | int, fill_gaps: bool = False, max_buckets: int | None = 10_000) -> DataFrame:
    """Larger bars of a stream of bars, in update mode, each batch giving those that it changes.

    A bar that comes again replaces the one of its time, with op = delete it goes; late bars
    change theirs, as long as it is one of the last max_buckets (None: always). The last bar
    is partial and comes again as it grows. fill_gaps: an empty bar between two others has
    no volume and the close before it. kind is upsert, or delete for a bar that is no more.
    """
    at = F.col("ts").cast("timestamp_ntz")
    rows = bars.select("series_key", at.alias("ts"), at.cast("string").alias("identity"), _gone(bars).alias("gone"), *(F.col(c).cast("double").alias(f"n{k}") for k, c in enumerate(OHLCV)))
    return _aggregated(rows, _BAR, interval, fill_gaps, max_buckets)


def stream_ticks(ticks: DataFrame, interval: str | int, fill_gaps: bool = False, max_buckets: int | None = 10_000, execution_id: str = "execution_id", order: list[str] | None = None) -> DataFrame:
    """Bars of a stream of ticks with corrections, in update mode, each batch giving those that it changes.

    A tick whose execution id has come before replaces the earlier one, with op = delete it
    goes; ticks without one all count. order: columns (whole numbers or texts) that settle
    which of equal times comes first, nulls before all; without it the ticks that came
    first, a corrected one last. All else is as in stream_resample().
    """
    named, own = F.col(execution_id), []
    for k, name in enumerate(order or []):
        kind = ticks.schema[name].dataType
        need(isinstance(kind, (T.IntegralType, T.StringType)), f"{name}: an order is of whole numbers or texts")
        # a null among whole numbers would make pandas round the others
        own.append((F.col(name) if isinstance(kind, T.StringType) else F.coalesce(F.col(name).cast("long"), F.lit(-(2**63)))).alias(f"o{k}"))
    identity = F.when(named != "", named.cast("string"))
    numbers = F.col("price").cast("double").alias("n0"), F.col("volume").cast("double").alias("n1")
    rows = ticks.select("series_key", F.col("ts").cast("timestamp_ntz").alias("ts"), identity.alias("identity"), _gone(ticks).alias("gone"), *numbers, *own)
    return _aggregated(rows, _TICK, interval, fill_gaps, max_buckets)

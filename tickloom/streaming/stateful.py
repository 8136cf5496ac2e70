"""Recursive operators over a stream with their state kept between batches.

A new bar costs one step of the kernel. Each series keeps its last bars, so that a late,
corrected or removed bar makes it go back no further than it must: the kernel runs again
from the state before the oldest bar kept, and all rows from the change on come out again.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.series import OHLCV, part
from ..plans.spec import Bound, need
from ..plans.stage import _TYPES, NAN, Fold, Stage

#: Times that one bar may come again unchanged before the stream counts as faulty.
REPEATS = 100


@dataclass
class SeriesState:
    """One series: the kernels before its oldest bar kept, the bars since, and the kernels now."""

    base: bytes
    now: bytes
    first: int = 0
    times: list[Any] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    pruned: Any = None
    repeats: int = 0


def folds_of(df: DataFrame, bound: Bound) -> tuple[Fold, ...]:
    """The kernels of an operator that is nothing but kernels over bars or one price."""
    op = bound.operator
    need(op.tier == "fold" and not op.reshapes, f"{op.id} is no running calculation")
    empty = df.sparkSession.createDataFrame([], "series_key string, ts timestamp_ntz, _i int, _price double, open double, high double, low double, close double, volume double")
    stage = op.build(Stage(empty, x="_price"), **bound.params)
    made = {x for f in stage.folds for x, _ in f.outputs}
    need(set(op.outputs) <= made and all(set(f.inputs) <= {"_x", *OHLCV} for f in stage.folds), f"{op.id} also needs frames of rows: use Live")
    return stage.folds


class Runner:
    """Takes rows of one series and gives changed results."""

    def __init__(self, folds: tuple[Fold, ...], max_cache: int):
        self.folds, self.max_cache = folds, max_cache

    def fresh(self) -> bytes:
        return cloudpickle.dumps([f.make() for f in self.folds])

    def step(self, steps: list[Callable], i: int, row: tuple) -> list:
        values = dict(zip((*OHLCV, "_x"), row, strict=True))
        return [y for f, s in zip(self.folds, steps, strict=True) for y in s(i, *(values[x] for x in f.inputs))]

    def take(self, s: SeriesState, rows: list[tuple[Any, str, tuple]]) -> list[tuple]:
        """rows of (time, op, values) in order of arrival -> (time, kind, results)."""
        out: list[tuple] = []
        late: dict[Any, tuple | None] = {}
        steps = pickle.loads(s.now)
        for at, op, row in rows:
            if not late and op != "delete" and (not s.times or at > s.times[-1]):
                out.append((at, "upsert", self.step(steps, s.first + len(s.times), row)))
                s.times.append(at)
                s.rows.append(row)
                s.repeats = 0
            elif s.pruned is not None and at <= s.pruned:
                continue  # older than all that is kept
            else:
                late[at] = None if op == "delete" else row
        if late:
            held = dict(zip(s.times, s.rows, strict=True))
            change = {t: r for t, r in late.items() if held.get(t) != r}
            s.repeats = s.repeats + len(late) - len(change) if len(late) > len(change) else 0
            if s.repeats > REPEATS:
                raise OverflowError("one bar comes again and again: the stream goes round in a circle")
            if change:
                start = min(change)
                out = [x for x in out if x[0] < start]
                out += [(t, "delete", None) for t, r in change.items() if r is None and t in held]
                held = {t: r for t, r in {**held, **change}.items() if r is not None}
                s.times = sorted(held)
                s.rows = [held[t] for t in s.times]
                steps = pickle.loads(s.base)
                for k, (t, r) in enumerate(zip(s.times, s.rows, strict=True)):
                    made = self.step(steps, s.first + k, r)
                    if t >= start:
                        out.append((t, "upsert", made))
        if len(s.times) > self.max_cache:
            drop = len(s.times) - self.max_cache
            base = pickle.loads(s.base)
            for k in range(drop):
                self.step(base, s.first + k, s.rows[k])
            s.base, s.first, s.pruned = cloudpickle.dumps(base), s.first + drop, s.times[drop - 1]
            s.times, s.rows = s.times[drop:], s.rows[drop:]
        s.now = cloudpickle.dumps(steps)
        return out


def stream_operator(bars: DataFrame, id: str, *args: Any, max_cache: int = 10_000, **params: Any) -> DataFrame:
    """Results of one recursive operator over a stream of bars, in update mode.

    bars: series_key, ts, open, high, low, close, volume, and op (upsert or delete) if any
    row removes a bar. Gives series_key, ts, the outputs and kind: upsert, or delete for a
    result that is no more. A late row that is older than the max_cache bars kept is dropped.
    """
    bound = Bound.of(id, *args, **params)
    op = bound.operator
    runner = Runner(folds_of(bars, bound), max_cache)
    outputs = [(x, k) for f in runner.folds for x, k in f.outputs]
    if "op" not in bars.columns:
        bars = bars.withColumn("op", F.lit("upsert"))
    price = part(op.price if op.needs != "bars" else "close").cast("double").alias("_x")
    rows = bars.select("series_key", "ts", "op", *(F.col(c).cast("double").alias(c) for c in OHLCV), price)
    schema = T.StructType([rows.schema["series_key"], rows.schema["ts"], *(T.StructField(x, _TYPES[k][0]) for x, k in outputs), T.StructField("kind", T.StringType())])

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            s = pickle.loads(state.get[0])
        else:
            s = SeriesState(runner.fresh(), runner.fresh())
        frame = pd.concat(list(parts))
        frame = frame.sort_values("ts", kind="stable")
        values = [tuple(NAN if v != v or v is None else float(v) for v in r) for r in frame[[*OHLCV, "_x"]].itertuples(index=False)]
        made = runner.take(s, list(zip(frame["ts"], frame["op"], values, strict=True)))
        state.update((cloudpickle.dumps(s),))
        if made:
            columns: dict[str, list] = {"series_key": [key[0]] * len(made), "ts": [m[0] for m in made]}
            for k, (name, _) in enumerate(outputs):
                got = [None if m[2] is None else m[2][k] for m in made]
                columns[name] = [None if v is None or v != v else v for v in got]
            columns["kind"] = [m[1] for m in made]
            yield pd.DataFrame({k: pd.Series(v, dtype=object if k not in ("ts",) else None) for k, v in columns.items()})

    return rows.groupBy("series_key").applyInPandasWithState(update, schema, "state binary", "update", GroupStateTimeout.NoTimeout)

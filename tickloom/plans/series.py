"""Series of bars or values, and chains of operators on them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import operators as _operators  # noqa: F401  fills the registry
from .spec import REGISTRY, Bound, need
from .stage import NAN, Fold, Stage, numbered

OHLCV = ["open", "high", "low", "close", "volume"]

#: Prices that one bar can stand for.
PARTS: dict[str, Callable[[], Column]] = {
    **{x: (lambda x=x: F.col(x)) for x in OHLCV},
    "hl2": lambda: (F.col("high") + F.col("low")) / 2,
    "hlc3": lambda: (F.col("high") + F.col("low") + F.col("close")) / 3,
    "oc2": lambda: (F.col("open") + F.col("close")) / 2,
    "ohl3": lambda: (F.col("open") + F.col("high") + F.col("low")) / 3,
    "ohlc4": lambda: (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4,
}


def part(name: str) -> Column:
    need(str(name).lower() in PARTS, f"a bar has the parts {sorted(PARTS)}")
    return PARTS[str(name).lower()]()


@dataclass(frozen=True)
class Series:
    """Rows of many series, told apart by key and ordered by ts. Nothing runs before its df is used."""

    df: DataFrame
    key: str = "series_key"
    ts: str = "ts"
    #: Column that the next operator reads; None for bars, which each operator reads in its own way.
    value: str | None = None
    #: The operator that made this, if one did, and its parameters.
    made_by: Bound | None = None
    #: All operators since the bars, in order.
    chain: tuple[Bound, ...] = ()

    @property
    def is_bars(self) -> bool:
        return self.value is None and self.made_by is None

    def use(self, name: str) -> Series:
        """A value series of one part of the bars."""
        return Series(self.df.select(self.key, self.ts, part(name).alias("value")), self.key, self.ts, "value")

    def _stage(self, bound: Bound) -> Stage:
        op = bound.operator
        own = numbered(self.df, self.key, self.ts)
        if op.needs == "bars":
            need(not set(OHLCV) - set(self.df.columns), f"{op.id} needs bars")
            return Stage(own, self.key, self.ts, "close")
        if self.is_bars:
            return Stage(own.withColumn("_price", part(op.price)), self.key, self.ts, "_price")
        need(self.value is not None, f"the results of {self.made_by.operator.id if self.made_by else 'this series'} have no value to go on with")
        return Stage(own.withColumn("_price", F.expr(self.value)), self.key, self.ts, "_price")

    def indicator(self, id: str, *args: Any, **params: Any) -> Series:
        """Results of one operator: the key, the time and its outputs, a row for each row here."""
        bound = Bound.of(id, *args, **params)
        op = bound.operator
        need(op.tier != "pair", f"{op.id} takes two series: use pair()")
        if op.id == "VWAP" and bound.params["start_date"] is not None:
            _check_start(self, bound.params["start_date"])
        done = op.build(self._stage(bound), **bound.params).ready()
        return Series(done.df.select(self.key, self.ts, *op.outputs), self.key, self.ts, op.value, bound, (*self.chain, bound))

    def __getattr__(self, name: str) -> Callable[..., Series]:
        if name.startswith("_") or name.upper().replace("_", "-") not in REGISTRY:
            raise AttributeError(name)
        return lambda *args, **params: self.indicator(name, *args, **params)

    def indicators(self, wanted: dict[str, tuple[str, dict[str, Any]]]) -> DataFrame:
        """Many operators at once: name -> (id, parameters). Outputs are called name_output.

        All window columns share one sort of the series, and all folds one pass; equal
        calls are made once.
        """
        stage: Stage | None = None
        made: dict[tuple, str] = {}
        columns: list[Column] = []
        for name, (id, params) in wanted.items():
            bound = Bound.of(id, **params)
            op = bound.operator
            need(op.tier != "pair" and not op.reshapes, f"{op.id} has rows of its own")
            same = (op.id, tuple(sorted(bound.params.items(), key=lambda x: x[0])))
            if same not in made:
                made[same] = name
                if stage is None:
                    stage = Stage(numbered(self.df, self.key, self.ts), self.key, self.ts, "close")
                stage = self._with(stage, bound, name)
            columns += [F.col(f"{made[same]}__{x}").alias(f"{name}_{x}") for x in op.outputs]
        need(stage is not None, "no operator is named")
        return stage.ready().df.select(self.key, self.ts, *columns)

    def _with(self, stage: Stage, bound: Bound, name: str) -> Stage:
        """stage with one more operator, everything of it behind a prefix."""
        op, before = bound.operator, set(stage.df.columns)
        if op.needs == "bars" or self.is_bars:
            price = part("close" if op.needs == "bars" else op.price)
        else:
            need(self.value is not None, "this series has no value to go on with")
            price = F.expr(self.value)
        hidden = [x for x in op.outputs if x in before]
        own = replace(stage, df=stage.df.withColumn("_price", price).withColumnsRenamed({x: f"_source_{x}" for x in hidden}), x="_price", folds=())
        need(not hidden or op.needs != "bars", f"{op.id}: its outputs have names of the source")
        done = op.build(own, **bound.params)
        rename = {c: f"{name}__{c}" for c in done.df.columns if c not in before and not c.startswith("_source_")}
        back = {f"_source_{x}": x for x in hidden}
        folds = tuple(Fold(tuple(rename.get(x, x) for x in f.inputs), tuple((f"{name}__{x}", k) for x, k in f.outputs), f.make) for f in done.folds)
        return replace(stage, df=done.df.withColumnsRenamed({**rename, **back}), folds=(*stage.folds, *folds))

    # ---- results

    def condense(self) -> Series:
        """Without rows that have no result: no value, no match of a candle, or no output at all."""
        columns = self.df.columns[2:]
        if "match" in columns:
            kept = F.col("match") != 0
        elif self.value is not None:
            v = F.expr(self.value)
            kept = v.isNotNull() & ~F.isnan(v.cast("double"))
        else:
            kept = F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull()
        return replace(self, df=self.df.filter(kept))

    def drop_warmup(self, rows: int | None = None) -> Series:
        """Without the first rows of each series: as many as given, or as the operator needs to settle."""
        need(rows is None or rows >= 0, "rows must not be negative")
        df = numbered(self.df, self.key, self.ts)
        if rows is not None:
            return replace(self, df=df.filter(F.col("_i") >= rows).drop("_i"))
        whole = Window.partitionBy(self.key)
        op = self.made_by.operator if self.made_by else None
        on = F.col(op.warmup_on) if op and op.warmup_on else F.expr(self.value or self.df.columns[2])
        first = F.min(F.when(on.isNotNull(), F.col("_i"))).over(whole)
        if op and op.warmup:
            df = df.withColumn("_first", F.coalesce(first, F.lit(0)))
            a, b = op.warmup(0, self.made_by.params), op.warmup(1_000_000, self.made_by.params)
            # rules are linear in the first row, or the larger of two such: these two, or a floor
            n = F.lit(a) if a == b else F.greatest(*(_line(op.warmup, self.made_by.params)))
            return replace(self, df=df.filter(F.col("_i") >= n).drop("_i", "_first"))
        return replace(self, df=df.withColumn("_first", F.coalesce(first, F.lit(0))).filter(F.col("_i") >= F.col("_first")).drop("_i", "_first"))

    def in_order(self) -> DataFrame:
        """The rows by series and time."""
        return self.df.orderBy(self.key, self.ts)

    def find(self, at: Any) -> DataFrame:
        """The row at one time of each series."""
        return self.df.filter(F.col(self.ts) == F.lit(at).cast(dict(self.df.dtypes)[self.ts]))

    def latest(self) -> DataFrame:
        """The last row of each series."""
        names = [c for c in self.df.columns if c != self.key]
        return self.df.groupBy(self.key).agg(F.max_by(F.struct(*names), self.ts).alias("_r")).select(self.key, *(F.col(f"_r.{c}").alias(c) for c in names))


def _line(rule: Callable[[int, dict], int], params: dict) -> list[Column]:
    """A rule max(a + b*n, ...) of the first row, as columns: its lines near 0 and far away."""
    out = []
    for low in (0, 1_000_000):
        slope = rule(low + 1, params) - rule(low, params)
        out.append(F.lit(rule(low, params) - slope * low) + slope * F.col("_first"))
    return out


def _check_start(series: Series, start: Any) -> None:
    early = series.df.groupBy(series.key).agg(F.min(series.ts).alias("t")).filter(F.col("t") > F.lit(start).cast(dict(series.df.dtypes)[series.ts]))
    need(early.isEmpty(), "start_date must not come before the first bar")


def pair(id: str, a: Series, b: Series, *args: Any, strict: bool = False, **params: Any) -> Series:
    """Results of an operator on two series, joined by key and time.

    strict: every row of one must have a partner in the other, else this is an error.
    """
    one, two = (x.df.select(F.col(x.key).alias("series_key"), F.col(x.ts).alias("ts"), (part("close") if x.is_bars else F.expr(x.value)).cast("double").alias(name)) for x, name in ((a, "value_a"), (b, "value_b")))
    if strict:
        apart = one.join(two, ["series_key", "ts"], "left_anti").select("ts").union(two.join(one, ["series_key", "ts"], "left_anti").select("ts"))
        need(apart.isEmpty(), "the two series have different times")
    return paired(id, one.join(two, ["series_key", "ts"]), *args, **params)


def paired(id: str, both: DataFrame, *args: Any, **params: Any) -> Series:
    """Results of an operator on two series that stand side by side already: series_key, ts, value_a, value_b."""
    bound = Bound.of(id, *args, **params)
    need(bound.operator.tier == "pair", f"{id} takes one series")
    done = bound.operator.build(Stage(numbered(both), x="value_a"), **bound.params).ready()
    return Series(done.df.select("series_key", "ts", *bound.operator.outputs), value=bound.operator.value, made_by=bound, chain=(bound,))


def null_as_nan(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(NAN))

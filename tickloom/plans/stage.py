"""One series table in the making: window columns and folds over it share one shuffle by series."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAN = float("nan")
_TYPES = {"double": (T.DoubleType(), pa.float64()), "boolean": (T.BooleanType(), pa.bool_()), "int": (T.IntegerType(), pa.int32()), "string": (T.StringType(), pa.string())}


@dataclass(frozen=True)
class Fold:
    """A kernel that sees the rows of each series in order. make() gives a fresh step(i, *inputs) -> outputs."""

    inputs: tuple[str, ...]
    outputs: tuple[tuple[str, str], ...]
    make: Callable[[], Callable[..., tuple]]


def clean(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c), c)


@dataclass(frozen=True)
class Stage:
    """A table of series with its row number; _x is the value column in use, NaN where there is none."""

    df: DataFrame
    key: str = "series_key"
    ts: str = "ts"
    x: str = "close"
    folds: tuple[Fold, ...] = field(default=())

    # ---- windows

    @property
    def order(self) -> Any:
        return Window.partitionBy(self.key).orderBy(self.ts)

    def rows(self, low: int, high: int = 0) -> Any:
        return self.order.rowsBetween(low, high)

    def last(self, n: int) -> Any:
        """The frame of the n rows that end here."""
        return self.rows(1 - n, 0)

    @property
    def past(self) -> Any:
        return self.rows(Window.unboundedPreceding, 0)

    def has(self, n: int) -> Column:
        """Whether n more rows follow."""
        return F.lead("_i", n).over(self.order).isNotNull()

    @property
    def i(self) -> Column:
        return F.col("_i")

    @property
    def v(self) -> Column:
        """The value in use; a missing one is NaN, which spoils each frame that holds it and no other."""
        return F.coalesce(F.col(self.x).cast("double"), F.lit(NAN))

    def lag(self, c: Column, n: int = 1) -> Column:
        return F.lag(c, n).over(self.order)

    def lead(self, c: Column, n: int = 1) -> Column:
        return F.lead(c, n).over(self.order)

    def from_row(self, i: int, c: Column) -> Column:
        """c from row i on, null before."""
        return F.when(self.i >= i, c)

    def mean(self, c: Column, n: int, start: int | None = None) -> Column:
        return self.from_row(n - 1 if start is None else start, F.avg(c).over(self.last(n)))

    def total(self, c: Column, n: int, start: int | None = None) -> Column:
        return self.from_row(n - 1 if start is None else start, F.sum(c).over(self.last(n)))

    def weighted(self, c: Column, weights: list[float], start: int | None = None) -> Column:
        """Sum of the last len(weights) rows times the weights, the oldest first."""
        values = F.collect_list(c).over(self.last(len(weights)))
        products = F.zip_with(values, F.array(*map(F.lit, weights)), lambda a, b: a * b)
        return self.from_row(len(weights) - 1 if start is None else start, F.aggregate(products, F.lit(0.0), lambda a, b: a + b))

    # ---- columns

    def add(self, **columns: Column) -> Stage:
        """Add columns; those of pending folds can be read after ready() only."""
        return replace(self, df=self.df.withColumns(columns))

    def summed(self, **columns: Column) -> Stage:
        """Add aggregates over each whole series: one row for each, joined on the partitioning that there is."""
        whole = self.df.groupBy(F.col(self.key).alias("_of")).agg(*(c.alias(k) for k, c in columns.items()))
        return replace(self, df=self.df.join(whole, F.col(self.key).eqNullSafe(F.col("_of")), "left").drop("_of"))

    def give(self, **columns: Column) -> Stage:
        """Add results: NaN becomes null."""
        return self.add(**{k: clean(c) for k, c in columns.items()})

    def fold(self, inputs: list[str], outputs: dict[str, str] | list[str], make: Callable[[], Callable[..., tuple]]) -> Stage:
        kinds = outputs if isinstance(outputs, dict) else dict.fromkeys(outputs, "double")
        return replace(self, folds=(*self.folds, Fold(tuple(inputs), tuple(kinds.items()), make)))

    def ready(self) -> Stage:
        """Run all pending folds in one pass over each series."""
        return replace(self, df=run_folds(self.df, self.key, self.folds), folds=()) if self.folds else self


def numbered(df: DataFrame, key: str = "series_key", ts: str = "ts") -> DataFrame:
    """df with the row number of each series, from 0."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(ts)) - 1)


def _run(step: Callable, arrays: list[np.ndarray], first: int, n: int) -> list:
    """Outputs of one kernel for n rows of a series from row `first` on, as arrays or lists."""
    many = getattr(step, "many", None)
    if not many or n == 1:
        return _one_by_one(step, arrays, first)
    missing = np.zeros(n, bool)
    for x in arrays:
        missing |= np.isnan(x)
    if not missing.any():
        return list(many(first, *arrays))
    # runs of rows without a missing value are taken at once, what lies between one by one
    cuts = [0, *(np.flatnonzero(missing[1:] != missing[:-1]) + 1).tolist(), n]
    parts = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        own = [x[a:b] for x in arrays]
        parts.append(_one_by_one(step, own, first + a) if missing[a] or b - a == 1 else list(many(first + a, *own)))
    return [np.concatenate([np.asarray(p[k], dtype=None if isinstance(p[k], np.ndarray) else object) for p in parts]).tolist() for k in range(len(parts[0]))]


def _one_by_one(step: Callable, arrays: list[np.ndarray], first: int) -> list:
    made = [step(first + k, *row) for k, row in enumerate(zip(*(x.tolist() for x in arrays), strict=True))]
    return [list(x) for x in zip(*made, strict=True)]


def run_folds(df: DataFrame, key: str, folds: tuple[Fold, ...]) -> DataFrame:
    """df with the outputs of folds.

    The rows come as the row-number window has left them: by series, in order. Each series
    is read as a stream of batches, so its length is no matter.
    """
    names = df.columns
    wanted = sorted({x for f in folds for x in f.inputs})
    outputs = [x for f in folds for x in f.outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = [f.make() for f in folds]
        expected = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = batch.schema.get_field_index
            numbers = batch.column(at("_i"))
            if numbers[0].as_py() != expected or numbers[n - 1].as_py() != expected + n - 1:
                raise ValueError("rows of a series are out of order")
            # a missing number is NaN to a kernel
            inputs = {x: batch.column(at(x)).cast(pa.float64()).to_numpy(zero_copy_only=False) for x in wanted}
            made = [y for f, s in zip(folds, steps, strict=True) for y in _run(s, [inputs[x] for x in f.inputs], expected, n)]
            expected += n
            columns = [pa.array(c, pa.float64(), from_pandas=True) if k == "double" else pa.array([None if x is None or x != x else x for x in c], _TYPES[k][1]) for c, (_, k) in zip(made, outputs, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *(x for x, _ in outputs)])

    schema = T.StructType([*df.schema.fields, *(T.StructField(x, _TYPES[k][0]) for x, k in outputs)])
    return df.groupBy(key).applyInArrow(run, schema)

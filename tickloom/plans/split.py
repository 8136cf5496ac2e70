"""Bounded operators over series too long for one task.

A series is cut into parts of many rows. Each part also gets the rows before and after it
that its frames reach, so parts are independent and results are those of the whole series.
Row numbers come from a range partition: each partition numbers its own rows, and sums of
the partitions before it give where they start. No task ever sees a whole series.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .series import OHLCV, Series, part
from .spec import Bound, need
from .stage import Stage

#: Operators whose every result depends on a bounded number of rows around it.
BOUNDED = {
    "SMA", "WMA", "HMA", "ALMA", "EPMA", "VWMA", "BB", "DONCHIAN", "AWESOME", "BOP", "CCI", "CHOP", "CMO", "DPO", "ROC", "STOCH", "UO", "WILLR",
    "AROON", "ICHIMOKU", "ROLLING-PIVOTS", "VORTEX", "CMF", "MFI", "TR", "STDEV", "SMA-ANALYSIS", "ULCER", "DOJI", "MARUBOZU", "BARPART",
    "FRACTAL", "SLOPE",
}


def reach(bound: Bound) -> tuple[int, int]:
    """Rows before and after that a result may depend on, at most."""
    n = 2 * sum(abs(v) for v in bound.params.values() if isinstance(v, int) and not isinstance(v, bool)) + 2
    if bound.operator.id == "ICHIMOKU":
        n += 4 * bound.params["kijun_periods"]
    return n, n if bound.operator.repaints else 0


def is_bounded(bound: Bound) -> bool:
    return bound.operator.id in BOUNDED and bound.params.get("moving_average_type", "SMA") == "SMA"


def is_local(bound: Bound) -> bool:
    """Whether results are the same for the rows around them alone, numbered anew: an intercept counts from the first row of all."""
    return is_bounded(bound) and bound.operator.id != "SLOPE"


def longest_frame(bound: Bound) -> int:
    """Rows that a stream must keep, at least, for one result."""
    return max((abs(v) for v in bound.params.values() if isinstance(v, int) and not isinstance(v, bool)), default=1)


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one where all runs on one machine and none is named."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        need(context.master.startswith("local"), "spark.checkpoint.dir must name a folder that the cluster shares")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = tempfile.mkdtemp(prefix="tickloom-")
            atexit.register(shutil.rmtree, _OWN[context.applicationId], True)
        named = _OWN[context.applicationId]
    return named.rstrip("/")


def _table(df: DataFrame) -> DataFrame:
    """df as a table in the folder that the cluster shares, read again."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/split-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered_apart(df: DataFrame, key: str, ts: str) -> DataFrame:
    """df with the row number of each series, from 0, found without a task for a whole series."""
    # as a table, since a range partition is drawn from a sample: all readers must see one and the same
    ranged = _table(df.repartitionByRange(key, ts).withColumn("_p", F.spark_partition_id()))
    local = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p", key).orderBy(ts)) - 1)
    before = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_p", key).agg(F.count(F.lit(1)).alias("_n")).select("_p", key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return local.join(starts, ["_p", key]).withColumn("_i", (F.col("_start") + F.col("_r")).cast("long")).drop("_p", "_r", "_start")


def indicator_in_parts(series: Series, id: str, *args: Any, rows: int = 1_000_000, **params: Any) -> Series:
    """Series.indicator() for bounded operators, with `rows` rows of a series in each part."""
    bound = Bound.of(id, *args, **params)
    op = bound.operator
    need(is_bounded(bound), f"{op.id} depends on a whole series")
    before, after = reach(bound)
    need(rows > 0, "rows must be positive")
    if op.needs == "bars":
        need(not set(OHLCV) - set(series.df.columns), f"{op.id} needs bars")
        own, x = series.df, "close"
    else:
        need(series.is_bars or series.value is not None, "this series has no value to go on with")
        own, x = series.df.withColumn("_price", part(op.price) if series.is_bars else F.expr(series.value)), "_price"
    df = numbered_apart(own, series.key, series.ts)
    home = F.floor(F.col("_i") / rows)
    # a row goes to all parts that its own row, those after it or those before it can need
    first, last = F.floor(F.greatest(F.col("_i") - after, F.lit(0)) / rows), F.floor((F.col("_i") + before) / rows)
    df = df.withColumn("_part_of", F.explode(F.sequence(first, last)))
    stage = Stage(df, [series.key, "_part_of"], series.ts, x)  # type: ignore[arg-type]
    done = op.build(stage, **bound.params).ready()
    return Series(done.df.filter(F.col("_part_of") == home).select(series.key, series.ts, *op.outputs), series.key, series.ts, op.value, bound)

"""From tables and ticks to bars."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.series import OHLCV, Series, numbered
from ..plans.spec import need

# Seconds of each interval code; a month has no fixed length.
INTERVALS = {"1m": 60, "2m": 120, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "4h": 14400, "1d": 86400, "1w": 604800, "1mo": 0}
#: Other ways to write a code.
ALIASES = {f"{n}{word}": f"{n}m" for n in (1, 2, 3, 5, 15, 30) for word in ("min", "minute" if n == 1 else "minutes")}
ALIASES |= {f"{n}{word}": f"{n}h" for n in (1, 2, 4) for word in ("hr", "hour" if n == 1 else "hours")}
ALIASES |= {"1day": "1d", "day": "1d", "1week": "1w", "week": "1w", "1month": "1mo", "month": "1mo"}
#: Seconds from the first day that buckets count from to 1970.
_ANCHOR = -62_135_596_800


def seconds_of(interval: str | int | float) -> int:
    """Seconds of a code or number; 0 for a month."""
    if isinstance(interval, (int, float)):
        need(interval > 0, "an interval must be positive")
        return int(interval)
    code = interval.strip().lower()
    code = ALIASES.get(code, code)
    need(code in INTERVALS, f"unknown interval {interval!r}")
    return INTERVALS[code]


def try_seconds_of(interval: str | int | float) -> int | None:
    """Seconds of a code or number, None for what is neither."""
    try:
        return seconds_of(interval)
    except ValueError:
        return None


def code_of(seconds: int | float) -> str:
    """The code of an interval of so many seconds; 0 is a month."""
    found = next((code for code, n in INTERVALS.items() if n == seconds), None)
    need(found is not None, f"no code for {seconds} seconds")
    return found


def bucket(ts: Column, interval: str | int | float) -> Column:
    """Start of the bucket that holds ts; weeks start on Monday."""
    seconds = seconds_of(interval)
    if not seconds:
        return F.date_trunc("month", ts)
    return F.window(ts, f"{seconds} seconds", f"{seconds} seconds", f"{_ANCHOR % seconds} seconds")["start"]


def as_bars(df: DataFrame, columns: Mapping[str, str] | None = None, key: str | None = None, ts: str = "ts") -> Series:
    """Bars from a table; columns maps open, high, low, close, volume to other names; without key all rows are one series."""
    named = {x: (columns or {}).get(x, x) for x in OHLCV}
    return Series(df.select((F.col(key) if key else F.lit("all")).alias("series_key"), F.col(ts).alias("ts"), *(F.col(c).cast("double").alias(x) for x, c in named.items())))


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", **rest) -> Series:
    """Bars from parquet, orc, csv or json files; csv needs a header and is read with the types of bars."""
    reader = spark.read
    if fmt in ("csv", "json"):
        reader = reader.schema("series_key string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    if fmt == "csv":
        reader = reader.option("header", True)
    return as_bars(reader.format(fmt).load(path), **{"key": "series_key", **rest})


def write_bars(series: Series, path: str, fmt: str = "parquet") -> None:
    writer = series.df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def ticks_to_bars(ticks: DataFrame, interval: str | int | float, key: str = "series_key", ts: str = "ts", price: str = "price", volume: str = "volume", execution_id: str | None = None, order: list[str] | None = None) -> Series:
    """Bars of trade ticks; a repeated execution id counts once, ticks without one all count.

    order: columns that settle which of equal times comes first.
    """
    if execution_id:
        named = ticks.filter(F.col(execution_id).isNotNull() & (F.col(execution_id) != ""))
        rest = ticks.filter(F.col(execution_id).isNull() | (F.col(execution_id) == ""))
        ticks = named.dropDuplicates([key, execution_id]).unionByName(rest)
    place = F.struct(F.col(ts), *map(F.col, order or []))
    p, v = F.col(price).cast("double"), F.col(volume).cast("double")
    grouped = ticks.groupBy(F.col(key).alias("series_key"), bucket(F.col(ts), interval).alias("ts"))
    return Series(grouped.agg(F.min_by(p, place).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, place).alias("close"), F.sum(v).alias("volume")))


def resample(bars: Series, interval: str | int | float) -> Series:
    """Larger bars; a bucket without bars is absent."""
    grouped = bars.df.groupBy(F.col(bars.key).alias("series_key"), bucket(F.col(bars.ts), interval).alias("ts"))
    return Series(grouped.agg(F.min_by("open", bars.ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", bars.ts).alias("close"), F.sum("volume").alias("volume")))


def fill_gaps(bars: Series, interval: str | int | float) -> Series:
    """Bars without volume at the last close, for every bucket between a series' first and last that has none."""
    seconds = seconds_of(interval)
    step = F.expr(f"interval {seconds} seconds" if seconds else "interval 1 month")
    after = F.lead(bars.ts).over(Window.partitionBy(bars.key).orderBy(bars.ts))
    # each bar brings the empty buckets up to the next one, so that no series needs one task's memory
    until = F.coalesce(after - step, F.col(bars.ts))
    made = bars.df.withColumn("_to", F.greatest(until, F.col(bars.ts))).withColumn("_at", F.explode(F.sequence(F.col(bars.ts), F.col("_to"), step)))
    own = F.col("_at") == F.col(bars.ts)
    pick = lambda c: F.when(own, F.col(c)).otherwise(F.col("close")).alias(c)
    return Series(made.select(F.col(bars.key).alias("series_key"), F.col("_at").alias("ts"), pick("open"), pick("high"), pick("low"), F.col("close"), F.when(own, F.col("volume")).otherwise(0.0).alias("volume")))


def problems(bars: Series) -> DataFrame:
    """Rows at a time that their series has twice."""
    return bars.df.groupBy(bars.key, bars.ts).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def validate(bars: Series) -> Series:
    """The same bars, or an error if a series has two at one time."""
    need(problems(bars).isEmpty(), "duplicate times in a series")
    return bars


def to_candles(bars: Series) -> DataFrame:
    """Bars with the sizes and shares of body and wicks."""
    from ..operators.patterns import candle_columns

    return bars.df.withColumns(candle_columns())


def shown(series: Series | DataFrame, rows: int = 20, digits: int = 4, start: int = 0, where: Column | str | None = None, formats: Mapping[str, str] | None = None) -> str:
    """Rows of each series as text with their index: `rows` of them from row `start` on, of those that `where` keeps.

    formats: for a column, or a Spark type such as double, how Python formats its values, as
    ".2f" or "%Y-%m-%d"; "unset" leaves them as they are.
    """
    series = series if isinstance(series, Series) else Series(series)
    kinds = dict(series.df.dtypes)
    df = numbered(series.df, series.key, series.ts)
    df = df if where is None else df.filter(where)
    place = F.row_number().over(Window.partitionBy(series.key).orderBy(series.ts)) - 1
    df = df.withColumn("_place", place).filter((F.col("_place") >= start) & (F.col("_place") < start + rows)).orderBy(series.key, series.ts)
    names = ["i", *series.df.columns]
    table = [[str(r["_i"]), *(_formatted(r[c], (formats or {}).get(c, (formats or {}).get(kinds[c])), digits) for c in series.df.columns)] for r in df.limit(rows * 50).collect()]
    wide = [max(len(x) for x in c) for c in zip(names, *table, strict=True)]
    return "\n".join("  ".join(x.rjust(w) for x, w in zip(row, wide, strict=True)) for row in [names, *table])


def shown_row(row: Row | Mapping, digits: int = 4, formats: Mapping[str, str] | None = None) -> str:
    """One row as text, a line for each of its values."""
    values = row.asDict() if isinstance(row, Row) else dict(row)
    wide = max((len(x) for x in values), default=0)
    return "\n".join(f"{x.rjust(wide)}  {_formatted(v, (formats or {}).get(x), digits)}" for x, v in values.items())


def _formatted(value, how: str | None, digits: int) -> str:
    if value is None:
        return ""
    if how is None or how.lower() == "unset":
        return f"{value:.{digits}f}" if isinstance(value, float) and how is None else str(value)
    return format(value, how)

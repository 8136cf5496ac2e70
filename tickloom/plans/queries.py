"""The operators as queries over the test tables: hourly bars of events by event type."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import bars as B
from .oracles import DIGITS, ITEM_DIGITS, NUDGE
from .series import PARTS, Series, pair, paired
from .split import indicator_in_parts, shared_folder

#: Query name -> (operator, parameters).
CALLS: dict[str, tuple[str, dict[str, Any]]] = {
    "sma": ("SMA", {"lookback_periods": 20}), "ema": ("EMA", {"lookback_periods": 20}), "smma": ("SMMA", {"lookback_periods": 20}), "dema": ("DEMA", {}), "tema": ("TEMA", {"lookback_periods": 20}),
    "trix": ("TRIX", {}), "t3": ("T3", {}), "kama": ("KAMA", {}), "mama": ("MAMA", {}), "ht_trendline": ("HTL", {}), "wma": ("WMA", {"lookback_periods": 14}),
    "hma": ("HMA", {}), "alma": ("ALMA", {}), "epma": ("EPMA", {}), "vwma": ("VWMA", {}), "bollinger_bands": ("BB", {}), "donchian": ("DONCHIAN", {}), "fcb": ("FCB", {}), "keltner": ("KELTNER", {}),
    "starc_bands": ("STARC", {}), "ma_envelopes": ("MA-ENV", {}), "stdev_channels": ("STDEV-CHANNELS", {}), "vwap": ("VWAP", {}), "awesome": ("AWESOME", {}), "bop": ("BOP", {}), "cci": ("CCI", {}),
    "chop": ("CHOP", {}), "cmo": ("CMO", {"lookback_periods": 14}), "connors_rsi": ("CRSI", {}), "dpo": ("DPO", {}), "gator": ("GATOR", {}), "pmo": ("PMO", {}), "roc": ("ROC", {}), "rsi": ("RSI", {}), "smi": ("SMI", {}),
    "stoch": ("STOCH", {}), "stoch_smma": ("STOCH", {"moving_average_type": "SMMA"}), "stoch_rsi": ("STOCH-RSI", {}), "stc": ("STC", {}), "tsi": ("TSI", {}), "ultimate": ("UO", {}), "williams_r": ("WILLR", {}), "adx": ("ADX", {}),
    "alligator": ("ALLIGATOR", {}), "aroon": ("AROON", {}), "atr_stop": ("ATR-STOP", {}), "super_trend": ("SUPERTREND", {}), "elder_ray": ("ELDER-RAY", {}), "ichimoku": ("ICHIMOKU", {}), "macd": ("MACD", {}),
    "pivot_points": ("PIVOT-POINTS", {"window_size": "day"}), "pivots": ("PIVOTS", {}), "roc_wb": ("ROC-WB", {}), "rolling_pivots": ("ROLLING-PIVOTS", {"point_type": "woodie"}), "vortex": ("VORTEX", {}),
    "chandelier": ("CHEXIT", {}), "parabolic_sar": ("PSAR", {}), "volatility_stop": ("VOL-STOP", {}), "adl": ("ADL", {}), "chaikin_osc": ("CHAIKIN-OSC", {}), "cmf": ("CMF", {}), "force_index": ("FORCE", {}), "kvo": ("KVO", {}),
    "mfi": ("MFI", {}), "obv": ("OBV", {}), "pvo": ("PVO", {}), "atr": ("ATR", {}), "tr": ("TR", {}), "std_dev": ("STDEV", {}), "slope": ("SLOPE", {}), "sma_analysis": ("SMA-ANALYSIS", {"lookback_periods": 20}),
    "ulcer_index": ("ULCER", {}), "hurst": ("HURST", {}), "doji": ("DOJI", {}), "marubozu": ("MARUBOZU", {}), "fractal": ("FRACTAL", {}), "fisher_transform": ("FISHER", {}), "heikin_ashi": ("HEIKINASHI", {}),
    "renko": ("RENKO", {"brick_size": 10}), "renko_atr": ("RENKO-ATR", {}), "zig_zag": ("ZIGZAG", {}),
}
PAIRS: dict[str, tuple[str, dict[str, Any]]] = {"beta": ("BETA", {"lookback_periods": 50, "type": "all"}), "correlation": ("CORR", {}), "prs": ("PRS", {"lookback_periods": 20})}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks: price and volume by event type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("series_key"), "ts", "event_id", F.col("value").alias("price"), (1 + F.col("event_id") % 100).alias("volume"))


def hourly(spark: SparkSession, sf_dir: str) -> Series:
    return B.ticks_to_bars(events(spark, sf_dir), "1h", order=["event_id"])


def daily_items(spark: SparkSession, sf_dir: str) -> Series:
    """Unit prices of line items by return flag and ship date."""
    e = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ticks = e.select(F.col("l_returnflag").alias("series_key"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"))
    return B.ticks_to_bars(ticks, "1d", order=["l_orderkey", "l_linenumber"])


def item_prices(spark: SparkSession, sf_dir: str) -> Series:
    """Each line item as a bar of its supplier: many series, no resampling."""
    e = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    # order and line make times of one day different
    at = F.expr("l_shipdate + make_dt_interval(0, 0, 0, (l_orderkey * 8 + l_linenumber) / 1000000)")
    return Series(e.select(F.col("l_suppkey").alias("series_key"), at.alias("ts"), price.alias("open"), (price * (1 + F.col("l_tax"))).alias("high"), (price * (1 - F.col("l_discount"))).alias("low"), price.alias("close"), F.col("l_quantity").alias("volume")))


def items_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"sma": ("SMA", {"lookback_periods": 20}), "ema": ("EMA", {"lookback_periods": 20}), "rsi": ("RSI", {}), "atr": ("ATR", {}), "macd": ("MACD", {})}
    return rounded(item_prices(spark, sf_dir).indicators(wanted), ITEM_DIGITS)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*((F.round(F.col(f.name) + float(NUDGE), digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields))


def _call(id: str, params: dict[str, Any]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(hourly(spark, sf_dir).indicator(id, **params).df)


def click_and_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly closes of two event types side by side: one aggregate, no join."""
    ticks = events(spark, sf_dir).filter(F.col("series_key").isin("click", "view"))
    of = lambda x: F.max_by(F.when(F.col("series_key") == x, F.col("price").cast("double")), F.when(F.col("series_key") == x, F.struct("ts", "event_id")))
    both = ticks.groupBy(F.lit("click").alias("series_key"), B.bucket(F.col("ts"), "1h").alias("ts")).agg(of("click").alias("value_a"), of("view").alias("value_b"))
    return both.filter(F.col("value_a").isNotNull() & F.col("value_b").isNotNull())


def _pair(id: str, params: dict[str, Any]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(paired(id, click_and_view(spark, sf_dir), **params).df)


def _joined_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highs against closes of the same bars: every row has its partner."""
    bars = hourly(spark, sf_dir)
    return rounded(pair("CORR", bars.use("high"), bars.use("close"), strict=True).df)


def _ticks_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of ticks of which every third comes twice."""
    ticks = events(spark, sf_dir).withColumn("execution_id", F.col("event_id").cast("string"))
    return B.ticks_to_bars(ticks.union(ticks.filter(F.col("event_id") % 3 == 0)), "1h", execution_id="execution_id", order=["event_id"]).df


# ---------------------------------------------------------------- streams

#: The range of click bars that one query removes.
REMOVED = ("2024-01-10 06:00:00", "2024-01-12 05:00:00")


def _batches(bars: DataFrame, n: int = 3) -> list[DataFrame]:
    """All rows, dealt out by time: each batch but the first brings late ones."""
    return [bars.filter(F.pmod(F.hash("ts"), F.lit(n)) == k) for k in range(n)]


def _drained(spark: SparkSession, parts: list[DataFrame], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The parts as batches of a stream, and of each result the last that came; removed ones are left out."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    for part in parts:  # all files of a part are one batch; the next part's query goes on from the checkpoint
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
        query = make(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    out = spark.read.parquet(f"{folder}/out").drop("batch")
    names = [c for c in out.columns if c not in ("series_key", "ts", "kind", "_batch")]
    last = out.groupBy("series_key", "ts").agg(F.max_by(F.struct("kind", *names), "_batch").alias("r")).filter("r.kind <> 'delete'")
    return last.select("series_key", F.col("ts").cast("timestamp_ntz").alias("ts"), *(F.col(f"r.{c}").alias(c) for c in names))


def _live(operate: Callable[[Series], Series], change: Callable[[Any], None] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..streaming.live import Live

        folder = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
        for part in _batches(hourly(spark, sf_dir).df):
            Live(spark, operate, folder).push(part)  # each batch by an object of its own, as after a restart
        if change:
            change(Live(spark, operate, folder))
        return rounded(Live(spark, operate, folder).results())

    return run


def _stream_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.stateful import stream_operator

    return rounded(_drained(spark, _batches(hourly(spark, sf_dir).df), lambda s: stream_operator(s, "EMA", 20)))


def _stream_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.ticks import stream_resample

    return _drained(spark, _batches(hourly(spark, sf_dir).df), lambda s: stream_resample(s, "4h", fill_gaps=True))


def _stream_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of which each tenth first comes with a wrong price."""
    from ..streaming.ticks import stream_ticks

    ticks = events(spark, sf_dir).withColumn("execution_id", F.col("event_id").cast("string"))
    wrong = F.col("event_id") % 10 == 0
    first = ticks.withColumn("price", F.when(wrong, F.col("price") + 1000).otherwise(F.col("price")))
    return _drained(spark, [first, ticks.filter(wrong)], lambda s: stream_ticks(s, "1h", max_buckets=None, order=["event_id"]))


def several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four operators in one pass."""
    wanted = {"fast": ("SMA", {"lookback_periods": 20}), "slow": ("EMA", {"lookback_periods": 20}), "strength": ("RSI", {}), "range": ("ATR", {})}
    return rounded(hourly(spark, sf_dir).indicators(wanted))


def _of(f: Callable[[Series], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(hourly(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _call(id, params) for name, (id, params) in CALLS.items()}
    out |= {name: _pair(id, params) for name, (id, params) in PAIRS.items()}
    own = ["size", "body", "upper_wick", "lower_wick", "body_pct", "upper_wick_pct", "lower_wick_pct", "is_bullish", "is_bearish"]
    out |= {
        "several": several,
        "chain_hl2_ema_rsi": _of(lambda b: rounded(b.use("hl2").ema(10).rsi(14).df)),
        "dynamic": _of(lambda b: rounded(b.sma(20).dynamic(14).df)),
        "bollinger_bands_in_parts": _of(lambda b: rounded(indicator_in_parts(b, "BB", rows=200).df)),
        "bars_hour": _of(lambda b: b.df),
        "bars_week": _of(lambda b: B.resample(b, "1w").df),
        "bars_month": _of(lambda b: B.resample(b, "1mo").df),
        "gaps_filled": _of(lambda b: B.fill_gaps(b, "1h").df),
        "bar_parts": _of(lambda b: rounded(b.df.select("series_key", "ts", *(PARTS[x]().alias(x) for x in ("hl2", "hlc3", "oc2", "ohl3", "ohlc4"))))),
        "candles": _of(lambda b: rounded(B.to_candles(b).select("series_key", "ts", *own))),
        "condensed": _of(lambda b: rounded(b.sma(20).condense().df)),
        "settled": _of(lambda b: rounded(b.ema(20).drop_warmup().df)),
        "latest": _of(lambda b: rounded(b.sma(20).latest())),
        "duplicate_times": lambda spark, d: B.problems(Series(events(spark, d).withColumn("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz")))),
        "strict_pair": _joined_pair,
        "ticks_once": _ticks_once,
        "found": _of(lambda b: rounded(b.sma(20).find("2024-01-15 10:00:00"))),
        "after_100_rows": _of(lambda b: rounded(b.ema(20).drop_warmup(100).df)),
        "pivot_points_hour": _of(lambda b: rounded(b.pivot_points("hour").df)),
        "pivot_points_week": lambda spark, d: rounded(daily_items(spark, d).pivot_points("week").df),
        "pivot_points_month": lambda spark, d: rounded(daily_items(spark, d).pivot_points("month", "woodie").df),
        "stoch_in_parts": _of(lambda b: rounded(indicator_in_parts(b, "STOCH", rows=150).df)),
        "slope_in_parts": _of(lambda b: rounded(indicator_in_parts(b, "SLOPE", rows=170).df)),
        "fractal_in_parts": _of(lambda b: rounded(indicator_in_parts(b, "FRACTAL", rows=130).df)),
        "stream_ema": _stream_ema,
        "stream_resampled": _stream_resampled,
        "stream_corrected_ticks": _stream_corrected,
        "live_sma": _live(lambda b: b.sma(20)),
        "live_obv": _live(lambda b: b.obv()),
        "live_removed_range": _live(lambda b: b.sma(20), lambda live: live.remove_range("click", *(dt.datetime.fromisoformat(x) for x in REMOVED))),
        "items_several": items_several,
        "items_super_trend": lambda spark, d: rounded(item_prices(spark, d).supertrend().df, ITEM_DIGITS),
        "daily_items_macd": lambda spark, d: rounded(daily_items(spark, d).macd().df),
    }
    return out

"""Operators over a stream of bars with late rows, corrections and removals.

Bars are kept as a table of changes in a folder; each batch adds its own, and the operator
runs on the series that it touches, before and after. What differs is the output, so rows
that an operator paints anew come out again. The folder is all there is to know: a new
process that opens it goes on where the last one stopped.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.series import OHLCV, Series
from ..plans.spec import need
from ..plans.split import is_local, longest_frame, reach

BAR = "series_key string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
CHANGES = f"{BAR}, op string, _batch long, _no long"
#: Batches in a row that may bring nothing but what is known before the stream counts as faulty.
REPEATS = 100
Sink = Callable[[DataFrame, int], None]


@dataclass
class Live:
    """An operator kept up to date.

    operate: bars to results, any chain of operators. Where all of the chain depend on a
    bounded number of rows, it runs over those around the changes; else over all bars of a
    series, so that what carries on from bar to bar is right at any length. path: a shared
    folder for the table of changes. max_cache: the last bars of each series that can still
    change and that bars() and results() give; late rows, corrections and removals older
    than all of them are dropped. It must hold the longest frame of the chain. compact:
    batches after which the table is written anew. keep_results: results() gives those of
    older bars too, as for bricks, which outlive their bars.
    """

    spark: SparkSession
    operate: Callable[[Series], Series]
    path: str
    max_cache: int = 100_000
    compact: int = 20
    keep_results: bool = False
    repeats: int = 0
    #: Sinks that have failed in the last batch, with what they raised.
    failures: dict[int, Exception] = field(default_factory=dict)

    def __post_init__(self) -> None:
        chain = self.operate(Series(self.spark.createDataFrame([], BAR))).chain
        least = sum(longest_frame(b) for b in chain)
        need(self.max_cache >= least, f"max_cache must be at least {least}, which one result depends on")
        bounded = bool(chain) and all(is_local(b) for b in chain)
        #: Rows before and after that a result depends on; None: all of them.
        self.reach = tuple(sum(x) for x in zip(*(reach(b) for b in chain), strict=True)) if bounded else None

    # ---- the folder

    def _files(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root, root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _versions(self) -> dict[str, int]:
        """The finished tables that hold now, with the number of batches that each ends: the last compact one and the batches since."""
        root, files = self._files()
        if not files.exists(root):
            return {}
        found = {}
        for x in files.listStatus(root):
            name = x.getPath().getName()
            if (m := re.fullmatch(r"(batch|compact)-(\d+)", name)) and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")):
                found[name] = int(m[2]) + (m[1] == "batch")
        whole = max((n for name, n in found.items() if name.startswith("compact")), default=0)
        return {name: n for name, n in found.items() if name == f"compact-{whole}" or name.startswith("batch") and n > whole}

    def _changes(self, but: str | None = None) -> DataFrame:
        versions = [f"{self.path}/{v}" for v in sorted(self._versions()) if v != but]
        return self.spark.read.schema(CHANGES).parquet(*versions) if versions else self.spark.createDataFrame([], CHANGES)

    def _bars(self, changes: DataFrame) -> DataFrame:
        """The bars that hold now: of each time the last change, unless it removes the bar."""
        latest = F.max_by(F.struct(*OHLCV, "op"), F.struct("_batch", "_no"))
        now = changes.groupBy("series_key", "ts").agg(latest.alias("r")).filter(F.col("r.op") != "delete")
        return now.select("series_key", "ts", *(F.col(f"r.{c}").alias(c) for c in OHLCV))

    def _cached(self, rows: DataFrame, bars: DataFrame) -> DataFrame:
        """rows that are no older than the last max_cache bars of their series; all of a series with fewer bars."""
        newest = Window.partitionBy("series_key").orderBy(F.col("ts").desc())
        oldest = bars.select("series_key", "ts", F.row_number().over(newest).alias("_k")).filter(F.col("_k") == self.max_cache)
        oldest = oldest.select(F.col("series_key").alias("_series"), F.col("ts").alias("_oldest"))
        joined = rows.join(oldest, F.col("series_key").eqNullSafe(F.col("_series")) & F.col("_oldest").isNotNull(), "left")
        return joined.filter(F.col("_oldest").isNull() | (F.col("ts") >= F.col("_oldest"))).select(*rows.columns)

    # ---- what there is

    def bars(self) -> DataFrame:
        bars = self._bars(self._changes())
        return self._cached(bars, bars)

    def results(self) -> DataFrame:
        """Results of the last max_cache bars, made from all bars."""
        bars = self._bars(self._changes())
        made = self.operate(Series(bars)).df
        return made if self.keep_results else self._cached(made, bars)

    # ---- changes

    def push(self, rows: DataFrame, batch: int | None = None) -> DataFrame:
        """Take a batch of bars, with op (upsert or delete) if it has one; gives the results that it changes.

        Of rows with one key and time the last of the batch counts. kind is upsert, or
        delete for a result that is no more. A batch that comes again replaces itself.
        """
        batch = max(self._versions().values(), default=0) if batch is None else batch
        if "op" not in rows.columns:
            rows = rows.withColumn("op", F.lit("upsert"))
        added = rows.select("series_key", "ts", *(F.col(c).cast("double").alias(c) for c in OHLCV), "op", F.lit(batch).cast("long").alias("_batch"), F.monotonically_increasing_id().alias("_no"))
        version = f"batch-{batch}"
        before = self._changes(but=version)
        self._cached(added, self._bars(before)).write.mode("overwrite").parquet(f"{self.path}/{version}")
        own = self.spark.read.schema(CHANGES).parquet(f"{self.path}/{version}")
        after = self._changes()
        touched = own.groupBy("series_key").agg(F.min("ts").alias("_low"), F.max("ts").alias("_high"))
        old, new = (self._around(self._bars(x.join(touched.select("series_key"), "series_key", "left_semi")), touched) for x in (before, after))
        changed = new.exceptAll(old).withColumn("kind", F.lit("upsert"))
        gone = old.join(new, ["series_key", "ts"], "left_anti").withColumn("kind", F.lit("delete"))
        return changed.unionByName(gone)

    def _around(self, bars: DataFrame, touched: DataFrame) -> DataFrame:
        """Results of the rows that a change from _low to _high can reach; of all rows, where that has no bound."""
        if self.reach is None:
            return self.operate(Series(bars)).df
        ahead, behind = self.reach
        reached = ahead + behind
        # rows on either side are counted from the change outwards, the change itself is 0
        near = bars.join(F.broadcast(touched) if touched.count() <= 100_000 else touched, "series_key")
        side = F.when(F.col("ts") < F.col("_low"), -1).when(F.col("ts") > F.col("_high"), 1).otherwise(0)
        near = near.withColumn("_side", side).withColumn("_away", F.unix_micros(F.col("ts").cast("timestamp")) * F.col("_side"))
        counted = near.withColumn("_n", F.when(F.col("_side") == 0, 0).otherwise(F.row_number().over(Window.partitionBy("series_key", "_side").orderBy("_away"))))
        kept = counted.filter(F.when(F.col("_side") < 0, F.col("_n") <= 2 * reached).otherwise(F.col("_n") <= 2 * reached))
        made = self.operate(Series(kept.select("series_key", "ts", *OHLCV))).df
        sure = kept.filter(F.col("_n") <= reached).select("series_key", "ts")
        return made.join(sure, ["series_key", "ts"], "left_semi")

    def remove_range(self, key: str, since, until=None) -> DataFrame:
        """Remove the bars of a series from a time on, up to another one if given; gives the results that this changes."""
        bars = self.bars().filter((F.col("series_key") == key) & (F.col("ts") >= F.lit(since)))
        if until is not None:
            bars = bars.filter(F.col("ts") <= F.lit(until))
        return self.push(bars.withColumn("op", F.lit("delete")))

    def compacted(self) -> None:
        """Write the bars that hold as one table; older tables go once it is whole."""
        versions = self._versions()
        if not versions:
            return
        last = max(versions.values())
        name = f"compact-{last}"
        if name in versions:
            return
        self._bars(self._changes()).withColumns({"op": F.lit("upsert"), "_batch": F.lit(last - 1).cast("long"), "_no": F.lit(-1).cast("long")}).write.mode("overwrite").parquet(f"{self.path}/{name}")
        _, files = self._files()
        for old in versions:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}"), True)

    def reset_fault(self) -> None:
        self.repeats = 0
        self.failures = {}

    def reinitialize(self) -> DataFrame:
        """Forget faults, write the table anew and give all results as they are now."""
        self.reset_fault()
        self.compacted()
        return self.results()

    def start(self, stream: DataFrame, sinks: Sink | list[Sink], checkpoint: str, on_error: Callable[[int, Exception], None] | None = None) -> StreamingQuery:
        """Run over a stream of bars; each sink gets what a batch changes.

        Sinks do not see each other's failures: all get the batch. on_error takes the number
        of a sink and what it raised; without it, a failure fails the batch after all sinks
        have had it, and the batch comes again.
        """
        sinks = sinks if isinstance(sinks, list) else [sinks]

        def each(rows: DataFrame, batch: int) -> None:
            made = self.push(rows, batch).cache()
            try:
                fresh = not made.isEmpty()
                self.repeats = 0 if fresh or rows.isEmpty() else self.repeats + 1
                if self.repeats > REPEATS:
                    raise OverflowError("the same bars come again and again: the stream goes round in a circle")
                self.failures = {}
                for k, sink in enumerate(sinks):
                    try:
                        sink(made, batch)
                    except Exception as problem:  # noqa: BLE001  one sink must not stop the others
                        self.failures[k] = problem
                        if on_error:
                            on_error(k, problem)
                if self.failures and not on_error:
                    raise next(iter(self.failures.values()))
            finally:
                made.unpersist()
            if self.compact and (batch + 1) % self.compact == 0:
                self.compacted()

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append").start()

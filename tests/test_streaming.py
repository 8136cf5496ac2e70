"""Streams give what whole tables give."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.plans.series import Series
from tickloom.sources import bars as B
from tickloom.streaming.live import BAR, Live
from tickloom.streaming.ticks import stream_bars

from .test_series import START, walk


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("operate", [lambda b: b.ema(5).rsi(3), lambda b: b.slope(5), lambda b: b.fractal()], ids=["chain", "slope", "fractal"])
def test_shuffled_batches_end_as_the_whole(spark, tmp_path, operate):
    rows = walk(40) + walk(30, "b", 2)
    order = rows[:]
    random.Random(4).shuffle(order)
    live = Live(spark, operate, str(tmp_path))
    state: dict = {}
    for k in range(0, len(order), 25):
        for r in live.push(spark.createDataFrame(order[k : k + 25], BAR)).collect():
            if r.kind == "upsert":
                state[r.series_key, r.ts] = tuple(r)[:-1]
            else:
                del state[r.series_key, r.ts]
    whole = rows_of(operate(Series(spark.createDataFrame(rows, BAR))).df)
    assert rows_of(live.results()) == whole
    assert sorted(state.values(), key=lambda x: x[:2]) == whole


def test_late_rows_corrections_and_removals(spark, tmp_path):
    rows = walk(20)
    live = Live(spark, lambda b: b.sma(3), str(tmp_path), compact=0)
    live.push(spark.createDataFrame(rows[:5] + rows[6:], BAR))
    late = {r.ts for r in live.push(spark.createDataFrame([rows[5]], BAR)).collect()}
    assert late == {rows[k][1] for k in (5, 6, 7)}
    fixed = (*rows[10][:5], rows[10][5] + 9, rows[10][6])
    assert {r.ts for r in live.push(spark.createDataFrame([fixed], BAR)).collect()} == {rows[k][1] for k in (10, 11, 12)}
    assert live.push(spark.createDataFrame([fixed], BAR)).count() == 0
    gone = live.push(spark.createDataFrame([(*fixed, "delete")], f"{BAR}, op string")).collect()
    assert {r.ts for r in gone if r.kind == "delete"} == {rows[10][1]}
    live.compacted()
    want = [r for k, r in enumerate(rows) if k != 10]
    assert rows_of(live.bars()) == sorted(want)


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    live = Live(spark, lambda b: b.sma(3), str(tmp_path))
    first = spark.createDataFrame(walk(10), BAR)
    assert rows_of(live.push(first, 0)) == rows_of(live.push(first, 0))
    assert live.bars().count() == 10


def test_old_bars_are_pruned(spark, tmp_path):
    live = Live(spark, lambda b: b.sma(3), str(tmp_path), max_cache=8)
    live.push(spark.createDataFrame(walk(20), BAR))
    assert live.bars().count() == 8


@pytest.mark.parametrize("operate", [lambda b: b.obv(), lambda b: b.ema(5)], ids=["obv", "ema"])
def test_results_past_the_cache_are_those_of_the_whole(spark, tmp_path, operate):
    rows = walk(40)
    want = rows_of(operate(Series(spark.createDataFrame(rows, BAR))).df)
    live = Live(spark, operate, str(tmp_path), max_cache=8, compact=0)
    seen: dict = {}
    for a, b in ((0, 20), (20, 30), (30, 40)):
        for r in live.push(spark.createDataFrame(rows[a:b], BAR)).collect():
            assert r.kind == "upsert" and r.ts >= rows[a][1]
            seen[r.ts] = tuple(r)[:-1]
        live.compacted()
    assert sorted(seen.values()) == want
    assert rows_of(live.results()) == want[-8:]
    late = (*rows[5][:5], rows[5][5] + 9, rows[5][6])
    assert live.push(spark.createDataFrame([late], BAR)).count() == 0
    assert rows_of(live.results()) == want[-8:]


def test_query_over_files(spark, tmp_path):
    source, rows = tmp_path / "in", walk(30)
    for k in range(3):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], BAR).coalesce(1).write.mode("append").parquet(str(source))
    live = Live(spark, lambda b: b.ema(4), str(tmp_path / "state"), compact=2)
    seen = []
    stream = spark.readStream.schema(BAR).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = live.start(stream, lambda df, batch: seen.append(df.count()), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert sum(seen) >= 30 and rows_of(live.results()) == rows_of(Series(spark.createDataFrame(rows, BAR)).ema(4).df)


def test_ticks_as_bars(spark, tmp_path):
    rnd = random.Random(2)
    ticks = [("a", START + dt.timedelta(seconds=30 * k), float(rnd.randint(1, 99)), 1.0, f"x{k}") for k in range(40)]
    schema = "series_key string, ts timestamp_ntz, price double, volume double, execution_id string"
    df = spark.createDataFrame(ticks, schema)
    df.union(df.limit(7)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = stream_bars(stream, "5m").writeStream.outputMode("complete").format("memory").queryName("tick_bars").start()
    q.processAllAvailable()
    q.stop()
    want = B.ticks_to_bars(df, "5m", execution_id="execution_id").df
    got = spark.table("tick_bars").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("operate", [lambda b: b.ema(5).rsi(3), lambda b: b.sma(5).sma(3), lambda b: b.fractal()], ids=["chain", "bounded", "fractal"])
def test_restart_between_any_two_batches(spark, tmp_path, operate):
    """Each batch is taken by a new process, so to say: the folder is all that it has."""
    rows = walk(40) + walk(30, "b", 2)
    order = rows[:]
    random.Random(6).shuffle(order)
    state: dict = {}
    for k in range(0, len(order), 25):
        live = Live(spark, operate, str(tmp_path))
        if k == 50:
            live.compacted()
        for r in live.push(spark.createDataFrame(order[k : k + 25], BAR)).collect():
            if r.kind == "upsert":
                state[r.series_key, r.ts] = tuple(r)[:-1]
            else:
                del state[r.series_key, r.ts]
    whole = rows_of(operate(Series(spark.createDataFrame(rows, BAR))).df)
    assert rows_of(Live(spark, operate, str(tmp_path)).results()) == whole
    assert sorted(state.values(), key=lambda x: x[:2]) == whole


def test_bounded_operators_read_the_rows_around_a_change(spark, tmp_path):
    rows = walk(300)
    seen = []

    def operate(b):
        seen.append(b.df)
        return b.sma(4)

    live = Live(spark, operate, str(tmp_path))
    live.push(spark.createDataFrame(rows[:299], BAR))
    live.push(spark.createDataFrame(rows[299:], BAR)).collect()
    assert seen[-1].count() < 60


def test_all_listed_streams_after_a_restart(spark, tmp_path):
    """Every operator that the catalog lists as a stream, but for those with rows of their own, in one go."""
    from tickloom.plans import catalog
    from tickloom.plans.spec import REQUIRED

    ops = [x.operator for x in catalog.listings("stream") if x.operator.tier != "pair" and not x.operator.reshapes]
    wanted = {op.id.lower().replace("-", "_"): (op.id, {p.name: p.shown for p in op.params if p.default is REQUIRED}) for op in ops}
    assert len(wanted) >= 70
    operate = lambda b: Series(b.indicators(wanted))
    rows = walk(90)
    for part in (rows[:60], rows[70:], rows[60:70]):  # bars are kept whatever the operator
        Live(spark, lambda b: b.sma(3), str(tmp_path)).push(spark.createDataFrame(part, BAR))
    assert rows_of_repr(Live(spark, operate, str(tmp_path)).results()) == rows_of_repr(operate(Series(spark.createDataFrame(rows, BAR))).df)


def rows_of_repr(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_bricks_outlive_their_bars(spark, tmp_path):
    rows = walk(60)
    live = Live(spark, lambda b: b.renko(2.0), str(tmp_path), max_cache=5, keep_results=True)
    live.push(spark.createDataFrame(rows, BAR))
    assert rows_of(live.results()) == rows_of(Series(spark.createDataFrame(rows, BAR)).renko(2.0).df)


def test_ranges_are_removed(spark, tmp_path):
    rows = walk(20)
    live = Live(spark, lambda b: b.sma(3), str(tmp_path))
    live.push(spark.createDataFrame(rows, BAR))
    gone = live.remove_range(rows[0][0], rows[12][1], rows[14][1]).collect()
    assert {r.ts for r in gone if r.kind == "delete"} == {rows[k][1] for k in (12, 13, 14)}
    live.remove_range(rows[0][0], rows[16][1])
    assert rows_of(live.reinitialize()) == rows_of(Series(spark.createDataFrame(rows[:12] + rows[15:16], BAR)).sma(3).df)


def test_a_cache_must_hold_a_frame(spark, tmp_path):
    with pytest.raises(ValueError, match="at least 20"):
        Live(spark, lambda b: b.sma(20), str(tmp_path), max_cache=19)


def test_sinks_do_not_see_each_others_failures(spark, tmp_path):
    source, rows = tmp_path / "in", walk(12)
    spark.createDataFrame(rows, BAR).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(BAR).parquet(str(source))
    got, told = [], []

    def broken(df, batch):
        raise RuntimeError("no")

    live = Live(spark, lambda b: b.sma(3), str(tmp_path / "state"))
    q = live.start(stream, [broken, lambda df, batch: got.append(df.count())], str(tmp_path / "check"), on_error=lambda k, e: told.append((k, str(e))))
    q.processAllAvailable()
    q.stop()
    assert got == [12] and told == [(0, "no")] and list(live.failures) == [0]


def test_bars_as_larger_bars_with_corrections_and_gaps(spark):
    from tickloom.streaming.ticks import Buckets

    rnd = random.Random(3)
    step = 3600 * 1_000_000
    base = [(START + dt.timedelta(minutes=10 * k), *sorted((float(rnd.randint(1, 99)), float(rnd.randint(1, 99)))), float(k)) for k in range(300) if not 40 <= k < 70 and not 150 <= k < 158]
    bars = {t: ("a", t, lo, hi, lo, hi, v) for t, lo, hi, v in base}
    micros = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    order = list(bars.values())
    rnd.shuffle(order)
    order += [(*r[:5], r[5], r[6] + 5) for r in order[:20]]  # corrected
    removed = [r[1] for r in order[30:36]]
    for fill in (False, True):
        held, shown = Buckets(), {}
        feed = [((str(r[1]),), micros(r[1]), "upsert", r[2:]) for r in order] + [((str(t),), micros(t), "delete", (0.0,) * 5) for t in removed]
        for k in range(0, len(feed), 17):
            for at, kind, bar in held.take(feed[k : k + 17], step, fill, 10_000):
                if kind == "upsert":
                    shown[at] = bar
                else:
                    del shown[at]
        left = {r[1]: r for r in order if r[1] not in removed}
        want = B.resample(Series(spark.createDataFrame(list(left.values()), BAR)), "1h")
        want = B.fill_gaps(want, "1h") if fill else want
        assert {micros(r.ts): tuple(r)[2:] for r in want.df.collect()} == shown


def test_pruned_buckets_keep_the_last_close():
    from tickloom.streaming.ticks import Buckets

    held, shown = Buckets(), {}
    step = 60 * 1_000_000
    for k in (0, 1, 2, 5, 9, 12):
        for at, _, bar in held.take([(None, k * step, "upsert", (k, k, k, float(k), 1.0))], step, True, 2):
            shown[at // step] = bar
    assert len(held.parts) == 2 and held.take([(None, 0, "upsert", (9,) * 5)], step, True, 2) == []
    assert [shown[k][3] for k in range(13)] == [0, 1, 2, 2, 2, 5, 5, 5, 5, 9, 9, 9, 12]


def test_streamed_ticks_with_corrections(spark, tmp_path):
    schema = "series_key string, ts timestamp_ntz, price double, volume double, execution_id string"
    source = str(tmp_path / "in")
    at = lambda m: START + dt.timedelta(minutes=m)
    for rows in ([("a", at(0), 5.0, 1.0, "x"), ("a", at(1), 7.0, 1.0, "y"), ("a", at(1), 6.0, 1.0, None)], [("a", at(1), 9.0, 2.0, "y"), ("a", at(11), 4.0, 1.0, "z")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    seen: dict = {}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    sink = lambda df, batch: seen.update({r.ts: tuple(r)[2:] for r in df.collect()})
    from tickloom.streaming.ticks import stream_ticks

    q = stream_ticks(stream, "5m", fill_gaps=True).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(sink).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(x[:5] for x in seen.values()) == sorted([(5.0, 9.0, 5.0, 9.0, 4.0), (9.0, 9.0, 9.0, 9.0, 0.0), (4.0, 4.0, 4.0, 4.0, 1.0)])


def test_equal_times_go_by_the_order_columns(spark, tmp_path):
    from tickloom.streaming.ticks import stream_ticks

    schema = "series_key string, ts timestamp_ntz, price double, volume double, execution_id string, place long, name string"
    late, big = START + dt.timedelta(minutes=1), 2**60
    batches = [
        [("a", START, 5.0, 1.0, "10", 10, "x"), ("a", START, 8.0, 1.0, "9", 9, "x"), ("a", late, 3.0, 1.0, "11", big + 1, "y"), ("a", late, 4.0, 1.0, "12", big, "y"), ("a", START, 6.0, 1.0, None, None, "x"), ("a", late, 2.0, 1.0, "13", big + 1, "b")],
        [("a", START, 7.0, 1.0, "9", 9, "x"), ("a", late, 9.0, 1.0, "12", big, "y")],
    ]
    seen: dict = {}
    for rows in batches:  # a new query each time, from the checkpoint
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        sink = lambda df, batch: seen.update({r.ts: tuple(r)[2:] for r in df.collect()})
        q = stream_ticks(stream, "5m", order=["place", "name"], max_buckets=None).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(sink).trigger(availableNow=True).start()
        q.awaitTermination()
    assert list(seen.values()) == [(6.0, 9.0, 2.0, 3.0, 6.0, "upsert")]


def test_a_kept_tick_costs_its_bytes():
    import pickle

    from tickloom.streaming.ticks import Buckets

    n, step = 20_000, 60 * 1_000_000
    held = Buckets()
    rows = [((f"{k:07}",), k * 1_000_000, "upsert", (1.0, 3.0, 0.5, 2.0, 1.0)) for k in range(n)]
    made = held.take(rows, step, False, 10_000)
    assert len(made) == len(held.parts) == -(-n // 60)
    assert len(pickle.dumps(held)) < 70 * n  # time, id, five numbers; 59 bytes and the bars
    first = held.take([(("0000007",), 7_000_000, "upsert", (1.0, 9.0, 0.5, 2.0, 1.0))], step, False, 10_000)
    assert first == [(0, "upsert", (1.0, 9.0, 0.5, 2.0, 60.0))]  # as old as it may be


def test_corrected_ticks_of_many_old_bars(spark, tmp_path):
    from tickloom.plans import queries

    # 12,000 hours, 20 ticks at each time: more bars than a stream keeps unless told
    hours, copies = 12_000, 20
    k = F.col("id")
    ticks = spark.range(hours * copies).select(k.alias("event_id"), F.lit("a").alias("event_type"), F.expr(f"timestamp_ntz '2024-01-01' + make_dt_interval(0, cast(id % {hours} as int))").alias("ts"), (k % 977).cast("double").alias("value"))
    ticks.write.parquet(str(tmp_path / "in" / "events.parquet"))
    got = queries._stream_corrected(spark, str(tmp_path / "in"))
    want = queries.hourly(spark, str(tmp_path / "in")).df
    assert rows_of(got) == rows_of(want) and got.count() == hours

"""Streaming operators equal their batch forms in whatever order readings
arrive; state and files stay bounded."""

import random

from pyspark.sql import functions as F

from cyclewise.operators import features as fe
from cyclewise.streaming import sequence as sq
from cyclewise.streaming import stream as sm

LATE = "1000000 seconds"


def _land(df, path, parts):
    """Rows by their ``part``, one file each, written one after another, which
    is the order in which a file source reads them."""
    for i in range(parts):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)


def _stream_of(spark, df, slices=3, max_files=1):
    """In order of time, ``slices`` files."""
    lo, hi = df.agg(F.min("timestamp"), F.max("timestamp")).first()
    path = sm.shared_dir(spark, "src")
    _land(df.withColumn("part", F.floor((F.col("timestamp") - lo) / ((hi - lo) / slices + 1))), path, slices)
    return sm.reading_stream(spark, path, df.schema, max_files)


def _shuffled(spark, df, parts=7, seed=3, max_files=2):
    """In no order, ``parts`` files, some of them empty, two a micro-batch."""
    path = sm.shared_dir(spark, "src")
    _land(df.withColumn("part", F.abs(F.hash("event_id", F.lit(seed))) % parts), path, parts)
    return sm.reading_stream(spark, path, df.schema, max_files)


def _run(spark, out, name):
    root = sm.shared_dir(spark, name)
    sm.run_available(out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    return spark.read.schema(out.schema).parquet(f"{root}/out"), f"{root}/ck"


def _readings(spark, n_engines=3, n=25):
    rows = []
    for e in range(n_engines):
        for c in range(1, n + 1):
            rows.append((e * 1000 + c, e, c, 1_700_000_000.0 + c * 100 + e, float((c * 7 + e) % 11), float((c * 3) % 5)))
    df = spark.createDataFrame(rows, "event_id long, engine_id long, cycle long, timestamp double, sensor_1 double, sensor_2 double")
    return df.withColumn("event_time", F.timestamp_seconds("timestamp"))


def test_rolling_stream_equals_batch(spark):
    df = _readings(spark)
    df = df.withColumn("sensor_2", F.when(F.col("cycle") % 6 != 0, F.col("sensor_2")))
    sensors = ["sensor_1", "sensor_2"]
    want = fe.add_rolling_features(df.select("engine_id", "cycle", *sensors), sensors)
    cols = [c for c in want.columns if "rolling" in c]
    w = want.select("engine_id", "cycle", *[F.round(c, 9).alias(c) for c in cols])
    for stream in (_stream_of(spark, df), _shuffled(spark, df)):
        got, _ = _run(spark, sq.rolling_stream(stream, sensors, watermark=LATE), "roll")
        g = got.select("engine_id", "cycle", *[F.round(c, 9).alias(c) for c in cols])
        assert g.count() == df.count() and g.exceptAll(w).count() == 0


def test_error_guard(spark):
    rng = random.Random(4)
    flags = {1: [True, False, False, True] + [False] * 6 + [True, True], 2: [rng.random() < 0.5 for _ in range(60)], 3: [False] * 5 + [True] + [False] * 5}
    rows = [(100 * e + i, e, i, 1_700_000_000.0 + 10 * i, ok) for e, f in flags.items() for i, ok in enumerate(f, start=1)]
    df = spark.createDataFrame(rows, "event_id long, engine_id long, cycle long, timestamp double, is_valid boolean")
    df = df.withColumn("event_time", F.timestamp_seconds("timestamp"))
    want = {}
    for e, f in flags.items():
        run = stopped = 0
        for i, ok in enumerate(f, start=1):
            run = 0 if ok else run + 1
            stopped = stopped or run > 5
            want[e, i] = ok and not stopped
    assert sorted(i for (e, i), d in want.items() if e == 1 and d) == [1, 4]  # stopped on the 6th error in a row
    for stream in (_stream_of(spark, df, slices=4), _shuffled(spark, df)):
        out, _ = _run(spark, sq.error_run_guard(stream, watermark=LATE), "guard")
        assert {(r.engine_id, r.cycle): r.delivered for r in out.collect()} == want


def test_missing_cycle_leaves_with_the_watermark(spark):
    """Cycle 3 never comes: 4 and 5 wait until the watermark has passed them.
    A cycle delivered twice counts once, rows without a cycle have no place."""
    t = {1: 1000.0, 2: 1010.0, 4: 1030.0, 5: 1040.0}
    rows = [(c, 1, c, t[c], True) for c in t] + [(2, 1, 2, 1010.0, True), (7, 1, None, 1015.0, True), (9, 2, 1, 5000.0, True), (10, 2, 2, 9000.0, True)]
    df = spark.createDataFrame(rows, "event_id long, engine_id long, cycle long, timestamp double, is_valid boolean").withColumn("event_time", F.timestamp_seconds("timestamp"))
    path = sm.shared_dir(spark, "src")
    _land(df.withColumn("part", F.when(F.col("engine_id") == 1, 0).otherwise(F.col("cycle"))), path, 3)
    out, _ = _run(spark, sq.error_run_guard(sm.reading_stream(spark, path, df.schema), watermark="60 seconds"), "gap")
    assert sorted((r.engine_id, r.cycle) for r in out.collect()) == [(1, 1), (1, 2), (1, 4), (1, 5), (2, 1), (2, 2)]


def test_state_expires(spark):
    rows = [(1, 1, 1, 1000.0), (2, 2, 1, 9000.0), (3, 2, 2, 9500.0)]
    df = spark.createDataFrame(rows, "event_id long, engine_id long, cycle long, timestamp double").withColumn("event_time", F.timestamp_seconds("timestamp"))
    for expire, left in ((None, {1, 2}), (600, {2})):
        _, ck = _run(spark, sq.staleness_events(_stream_of(spark, df), expire=expire, watermark="10 seconds"), "expire")
        state = spark.read.format("statestore").option("path", ck).option("stateVarName", "carry").load()
        assert {r[0] for r in state.select("key.engine_id").collect()} == left


def test_bounded_buffer(spark):
    df = _readings(spark, n_engines=8, n=25)  # 200 readings
    stream = _stream_of(spark, df, slices=4)
    root = sm.shared_dir(spark, "topics")
    q = (stream.writeStream.foreachBatch(sm.fan_out(root, bound=100, topics={"sensor_data": lambda b: b}))
         .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    sm.run_available(q)
    buf = sm.latest_version(spark, f"{root}/sensor_data/latest")
    assert buf.count() == 100
    want = df.orderBy(F.col("timestamp").desc(), F.col("event_id").desc()).limit(100)
    assert buf.select(want.columns).exceptAll(want).count() == 0
    assert sm.topic_log(spark, root, "sensor_data").count() == 200


def test_progress_upserts(spark):
    df = _readings(spark)
    root = sm.shared_dir(spark, "prog")
    q = (sm.engine_progress(_stream_of(spark, df)).writeStream.outputMode("update").foreachBatch(sm.upsert_log(root, ["engine_id"], every=2))
         .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    sm.run_available(q)
    got = {r.engine_id: (r.readings_seen, r.max_cycle) for r in sm.read_upserts(spark, root, ["engine_id"]).collect()}
    assert got == {0: (25, 25), 1: (25, 25), 2: (25, 25)}


def test_upserts_are_compacted_and_replayed(spark):
    rng = random.Random(8)
    batches = [{rng.randint(0, 9): rng.random() for _ in range(3)} for _ in range(26)]
    root, newest = sm.shared_dir(spark, "log"), {}
    write = sm.upsert_log(root, ["k"], every=4)
    for n, b in enumerate(batches):
        df = spark.createDataFrame(list(b.items()), "k int, v double").coalesce(1)
        write(df, n)
        if n % 4 == 3 or n == 5:
            write(df, n)  # a batch that was killed runs again
        newest |= b
        if n % 6 == 0 or n > 23:
            assert {r.k: r.v for r in sm.read_upserts(spark, root, ["k"]).collect()} == newest
        assert len(sm._numbers(spark, f"{root}/log", "batch")) <= 8 and len(sm._numbers(spark, f"{root}/base", "upto")) <= 2
    # a compaction that died half-way does not count
    spark.createDataFrame([(1, -1.0, 99)], "k int, v double, _batch long").write.parquet(f"{root}/base/upto=99")
    sm._remove(spark, f"{root}/base/upto=99/_SUCCESS")
    assert {r.k: r.v for r in sm.read_upserts(spark, root, ["k"]).collect()} == newest


def test_observed_counters_equal_batch(spark):
    rows = [(i, i % 3 == 0, i % 4, 1000.0 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "event_id long, is_valid boolean, n_corrections int, timestamp double")
    q = sm.observed(_shuffled(spark, df, parts=5)).writeStream.format("noop").option("checkpointLocation", sm.shared_dir(spark, "ck")).trigger(availableNow=True).start()
    sm.run_available(q)
    p = sm.Progress().update(q).update(q)  # a report counts once
    assert p.totals == {"total_validated": 50, "validation_errors": 33, "corrections_made": sum(i % 4 for i in range(50))}
    assert p.rows == 50 and p.rate() > 0


def test_staleness(spark):
    rows = [(1, 1, 1, 1000.0), (2, 1, 2, 1010.0), (3, 2, 1, 1005.0), (4, 2, 2, 1500.0), (5, 2, 3, 1510.0), (6, 3, 1, 1490.0)]
    df = spark.createDataFrame(rows, "event_id long, engine_id long, cycle long, timestamp double").withColumn("event_time", F.timestamp_seconds("timestamp"))
    want = [(1, 1010.0), (2, 1005.0)]
    # in order: gaps and timers tell; engine 3 has been silent for 20 s only
    out, ck = _run(spark, sq.staleness_events(_stream_of(spark, df), watermark="0 seconds"), "stale")
    assert sorted((r.engine_id, r.last_seen) for r in out.collect()) == want
    assert sq.open_silences(spark, ck, 1510.0).count() == 0  # told already
    # in no order: no timer fires, the state knows who is silent
    out, ck = _run(spark, sq.staleness_events(_shuffled(spark, df), watermark=LATE), "stale")
    told = out.unionByName(sq.open_silences(spark, ck, 1510.0))
    assert sorted((r.engine_id, r.last_seen) for r in told.collect()) == want


def test_archive_batches_do_not_grow_with_the_files(spark):
    """Forty files are four micro-batches, not fourteen."""
    df = spark.range(0, 400, 1, 40)
    stream, written = sm.stream_table(df, sm.shared_dir(spark, "many"))
    assert len(written.inputFiles()) == 40
    q = stream.writeStream.format("noop").option("checkpointLocation", sm.shared_dir(spark, "ck")).trigger(availableNow=True).start()
    sm.run_available(q)
    rows = [p.numInputRows for p in q.recentProgress if p.numInputRows]
    assert sum(rows) == 400 and len(rows) <= sm.ARCHIVE_BATCHES


def test_released_rows_travel_as_one(spark):
    """A run of readings leaves its engine as one row and comes apart again, with
    what is missing and whole numbers no double can hold."""
    T = sq.T
    out = T.StructType([T.StructField("cycle", T.LongType()), T.StructField("a", T.DoubleType()), T.StructField("ok", T.BooleanType()), T.StructField("b", T.DoubleType()), T.StructField("event_id", T.LongType())])
    rows = {"cycle": [1, 2, 3], "a": [0.5, None, float("inf")], "ok": [True, None, False], "b": [1.0, 2.0, None], "event_id": [2**60 + 1, None, 7]}
    arrays = {f.name: sq.column(rows[f.name], f.dataType) for f in out.fields}
    (frame,) = sq.packed(5, arrays, out)
    assert len(frame) == 1
    packed = spark.createDataFrame(frame, sq.packed_schema(T.StructField("engine_id", T.LongType()), out))
    got = sorted(tuple(r) for r in sq.unpacked(packed, out).collect())
    assert got == [(5, *r) for r in zip(*rows.values(), strict=True)]
    assert not list(sq.packed(5, {c: v[:0] for c, v in arrays.items()}, out))

"""Skew-safe numbering and chunked windows equal the plain window forms."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cyclewise.operators.features import forward_fill
from cyclewise.operators.ordering import engine_windows, number_rows, rows_back
from cyclewise.sources.tables import event_readings_unnumbered, table


def _base(spark, sf):
    return event_readings_unnumbered(table(spark, sf, "events"))


def test_number_rows_matches_row_number(spark, sf_small):
    base = _base(spark, sf_small)
    # one engine holds a third of the rows
    hot = base.withColumn("engine_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("engine_id")))
    for buckets in (1, 5, 37):
        got = number_rows(hot, "engine_id", ["ts", "event_id"], buckets=buckets)
        want = hot.withColumn("c2", F.row_number().over(Window.partitionBy("engine_id").orderBy("ts", "event_id")))
        j = got.join(want.select("event_id", "c2"), "event_id")
        assert j.count() == hot.count()
        assert j.where("cycle != c2").count() == 0


def test_hot_key_is_split(spark, sf_small):
    base = _base(spark, sf_small).withColumn("engine_id", F.lit(7))
    from cyclewise.operators.ordering import _split_points, with_keys

    pts = _split_points(with_keys(base, "engine_id"), "engine_id", ["ts", "event_id"], 8, 100_000)
    assert pts is not None
    assert pts.select(F.size("_bounds")).first()[0] == 7  # 8 buckets for the single hot key


def test_chunked_windows_match_native(spark, sf_small):
    r = number_rows(_base(spark, sf_small), "engine_id", ["ts", "event_id"])

    def cols(w):
        return [F.avg("sensor_1").over(rows_back(w, 5)).alias("m5"), F.lag("sensor_1").over(w).alias("lg"),
                F.stddev_samp("sensor_1").over(rows_back(w, 3)).alias("s3")]

    got = engine_windows(r, cols, halo=4, chunk_rows=5, engine_aggs=[F.max("cycle").alias("mx")])
    w = Window.partitionBy("engine_id").orderBy("cycle")
    want = r.select("event_id", F.avg("sensor_1").over(w.rowsBetween(-4, 0)).alias("m5b"),
                    F.lag("sensor_1").over(w).alias("lgb"), F.stddev_samp("sensor_1").over(w.rowsBetween(-2, 0)).alias("s3b"),
                    F.max("cycle").over(Window.partitionBy("engine_id")).alias("mxb"))
    j = got.join(want, "event_id")
    assert j.count() == r.count()
    bad = j.where("abs(m5 - m5b) > 1e-9 OR NOT (lg <=> lgb) OR NOT (round(s3, 9) <=> round(s3b, 9)) OR mx != mxb")
    assert bad.count() == 0


def test_forward_fill_across_chunks(spark):
    rows = [(1, c, v) for c, v in [(1, 1.0), (2, None), (3, float("inf")), (4, None), (5, 5.0), (6, None), (7, None)]]
    rows += [(2, 1, None), (2, 2, 3.0)]
    df = spark.createDataFrame(rows, "engine_id long, cycle long, x double")
    for chunk, block in ((1, 2), (2, 1), (2, 2), (3, 4096), (100, 4096)):
        got = {(r.engine_id, r.cycle): r.x for r in forward_fill(df, ["x"], chunk_rows=chunk, carry_block=block).collect()}
        assert got[(1, 2)] == 1.0 and got[(1, 3)] == 1.0 and got[(1, 4)] == 1.0
        assert got[(1, 6)] == 5.0 and got[(1, 7)] == 5.0
        assert got[(2, 1)] == 0.0 and got[(2, 2)] == 3.0


def test_repartition_invariance(spark, sf_small):
    from cyclewise.plans import REGISTRY

    q = REGISTRY["rolling_features"]
    a = q.run(spark, sf_small)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        b = q.run(spark, sf_small)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_gapped_cycles_need_positions(spark):
    rows = [(1, c, float(c)) for c in (1, 2, 3, 10, 11, 500, 501)] + [(2, 7, 1.0), (2, 9, 2.0)]
    df = spark.createDataFrame(rows, "engine_id long, cycle long, x double")
    got = engine_windows(df, lambda w: [F.lag("x").over(w).alias("prev")], halo=1, chunk_rows=2, dense=False)
    prev = {(r.engine_id, r.cycle): r.prev for r in got.collect()}
    assert prev[(1, 10)] == 3.0 and prev[(1, 500)] == 11.0 and prev[(2, 9)] == 1.0 and prev[(1, 1)] is None
    assert len(prev) == len(rows)


def test_renumbering_path_equals_materialised(spark, sf_small, monkeypatch):
    from cyclewise.sources.tables import event_readings

    a = event_readings(spark, sf_small, columns=["sensor_1"]).select("event_id", "cycle")
    monkeypatch.setenv("CYCLEWISE_MATERIALISE_READINGS", "0")
    b = event_readings(spark, sf_small, columns=["sensor_1"]).select("event_id", "cycle")
    assert a.count() == b.count() and a.exceptAll(b).count() == 0

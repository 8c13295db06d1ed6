"""Readers and writers on small generated files (scratch under the
checkpoint folder)."""

from pyspark.sql import functions as F

from cyclewise.sources import readers as rd
from cyclewise.sources import records as rc
from cyclewise.streaming.stream import shared_dir


def _write_lines(spark, lines):
    path = shared_dir(spark, "lines")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def test_sensor_log_trailing_blanks(spark):
    path = _write_lines(spark, ["1 1 0.5 0.25 100.0  ", "", "1 2 0.6 bad 101.0"])
    df = rd.read_sensor_log(spark, path, ["engine_id", "cycle", "setting_1", "sensor_1", "sensor_2"])
    rows = df.orderBy("cycle").collect()
    assert len(rows) == 2 and rows[0].sensor_2 == 100.0 and rows[1].sensor_1 is None


def test_rul_truth_line_numbers(spark):
    path = _write_lines(spark, ["112", "98", "69"])
    got = {r.engine_id: r.rul for r in rd.read_rul_truth(spark, path).collect()}
    assert got == {1: 112.0, 2: 98.0, 3: 69.0}


def test_rul_truth_over_files_and_blocks(spark):
    """Numbers go on from file to file and over the blocks that a file is read in."""
    lines = [str(i * 3 % 1009) for i in range(5000)]
    path = shared_dir(spark, "lines")
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i long, value string")
    # a blank line has no number
    df = df.repartitionByRange(4, "i").sortWithinPartitions("i").selectExpr("if(i % 100 = 50, concat(value, '\\n  '), value) value")
    df.write.text(path)
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "2k")
    try:
        got = {r.engine_id: r.rul for r in rd.read_rul_truth(spark, path).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {i + 1: float(x) for i, x in enumerate(lines)}
    empty = shared_dir(spark, "lines")
    df.limit(0).write.text(empty)
    assert rd.read_rul_truth(spark, empty).count() == 0


def test_processed_csv_short_and_long_rows(spark):
    path = _write_lines(spark, ["a,b,c", "1,2,3", "4,5", "6,7,8,9"])
    rows = rd.read_processed_csv(spark, path).orderBy("a").collect()
    assert [(r.a, r.b, r.c) for r in rows] == [(1.0, 2.0, 3.0), (6.0, 7.0, 8.0)]


def test_nested_record_and_json(spark):
    df = spark.createDataFrame([(1, 2, 10.5, 0.1, 0.2, 0.0, 3, "x")],
                               "engine_id long, cycle long, timestamp double, sensor_1 double, sensor_1_trend double, "
                               "setting_1 double, RUL long, tag string")
    n = rc.nest_reading(df)
    r = n.first()
    assert r.sensors == {"sensor_1": 0.1, "sensor_1_trend": 0.2} and r.settings == {"setting_1": 0.0}
    assert r.metadata == {"RUL": "3", "tag": "x"}
    assert n.select(rc.raw_sensor_names(F.col("sensors")).alias("k")).first().k == ["sensor_1"]
    back = rc.from_json_records(rc.to_json_records(n)).first()
    assert back == r


def test_training_tables_written(spark, sf_small):
    from cyclewise.plans.preparation import prepare_training_tables, write_training_tables
    from cyclewise.sources.tables import event_readings

    r = event_readings(spark, sf_small).select("engine_id", "cycle", "setting_1", "sensor_1", "sensor_2", "sensor_3")
    t = prepare_training_tables(r, seq_len=5)
    root = shared_dir(spark, "training")
    write_training_tables(t, root)
    assert spark.read.parquet(f"{root}/train_processed").count() == r.count()
    stats = spark.read.parquet(f"{root}/normalization_stats")
    assert stats.count() == len(t.features) == 47
    seq = spark.read.parquet(f"{root}/sequences").first()
    assert len(seq.steps) == 5 and len(seq.steps[0]) == 47
    # scaled features have mean 0 and population std 1 (or 0 when constant)
    m = spark.read.parquet(f"{root}/train_processed").agg(F.avg("sensor_1_rolling_mean_5"), F.stddev_pop("sensor_1_rolling_mean_5")).first()
    assert abs(m[0]) < 1e-9 and abs(m[1] - 1.0) < 1e-9

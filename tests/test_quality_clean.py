"""Validation (the reference's valid / invalid reading checks) and cleaning."""

from pyspark.sql import functions as F

from cyclewise.operators import clean as cl
from cyclewise.operators import quality as qa

TEXT = "engine_id string, cycle string, timestamp string, sensor_1 string, sensor_2 string, setting_1 string"


def test_valid_reading(spark):
    df = spark.createDataFrame([("1", "50", "1700000000.5", "0.5", "-0.3", "1.0")], TEXT)
    r = qa.validate(df).first()
    assert r.is_valid and r.n_issues == 0 and r.engine_id == 1 and r.cycle == 50 and r.sensor_1 == 0.5
    assert r.n_corrections == 6  # every text field coerced


def test_invalid_reading(spark):
    schema = "engine_id string, cycle string, sensor_1 string"
    df = spark.createDataFrame([("invalid", "-1", "not_a_number")], schema)
    r = qa.validate(df).first()
    assert not r.is_valid and r.n_issues >= 1
    assert "Missing required field: timestamp" in r.issues
    assert "Invalid type for engine_id: <class 'str'>" in r.issues
    assert "Invalid sensor value for sensor_1: not_a_number" in r.issues
    assert r.sensor_1 == 0.0 and r.cycle == -1  # ids are type-checked only


def test_range_clamp_keeps_valid(spark):
    df = spark.createDataFrame([("1", "1", "1.0", "10.0"), ("1", "2", "2.0", "-10.0"), ("1", "3", "3.0", "nan")],
                               "engine_id string, cycle string, timestamp string, sensor_1 string")
    hist = spark.createDataFrame([(0.0,), (1.0,)], "sensor_1 double")
    rng = qa.learn_ranges(hist, ["sensor_1"])
    lo, hi = rng.first()
    assert abs(lo + 0.1) < 1e-12 and abs(hi - 1.1) < 1e-12
    out = {r.cycle: r for r in qa.validate(df, rng).collect()}
    assert out[1].is_valid and abs(out[1].sensor_1 - 1.1) < 1e-12 and out[1].n_issues == 1
    assert abs(out[2].sensor_1 + 0.1) < 1e-12
    assert abs(out[3].sensor_1 - 1.1) < 1e-12  # NaN clamps to the upper bound
    c = qa.validation_counters(qa.validate(df, rng)).first()
    assert (c.total_validated, c.validation_errors) == (3, 0)


def test_keep_latest_per_engine(spark):
    df = spark.createDataFrame([(1, c) for c in range(1, 201)] + [(2, 1)], "engine_id long, cycle long")
    out = qa.keep_latest_per_engine(df, n=100)
    assert out.where("engine_id = 1").count() == 100 and out.where("engine_id = 1").agg(F.min("cycle")).first()[0] == 101
    assert out.where("engine_id = 2").count() == 1


def test_cleaning(spark):
    df = spark.createDataFrame([(1, 1, float("inf"), 5.0), (1, 2, None, -1.0), (1, 3, 3.0, None), (1, 4, 1.0, 2.0)],
                               "engine_id long, cycle long, x double, RUL double")
    assert [r.x for r in cl.inf_to_zero(df, ["x"]).orderBy("cycle").collect()] == [0.0, 0.0, 3.0, 1.0]
    assert [r.x for r in cl.median_impute(df, ["x"]).orderBy("cycle").collect()] == [2.0, 2.0, 3.0, 1.0]
    assert [r.cycle for r in cl.valid_target(df).orderBy("cycle").collect()] == [1, 4]
    const = {r.feature: r.is_constant for r in cl.constant_columns(df.withColumn("k", F.lit(1.0)), ["x", "k"]).collect()}
    assert const["k"] is True
    filled = cl.fill_missing_features(df.select("engine_id", "x"), ["x", "sensor_9"])
    assert filled.columns[-2:] == ["x", "sensor_9"] and filled.agg(F.sum("sensor_9")).first()[0] == 0.0


def test_chosen_engines(spark):
    df = spark.createDataFrame([(i, 1) for i in range(10, 0, -1)], "engine_id long, cycle long")
    assert sorted(r.engine_id for r in cl.chosen_engines(df).collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.engine_id for r in cl.chosen_engines(df, [2, 99]).collect()) == [2]
    import pytest

    with pytest.raises(ValueError):
        cl.require_rows(cl.chosen_engines(df, [99]))

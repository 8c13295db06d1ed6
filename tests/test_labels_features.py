"""Labels and features on hand-made frames (edge cases from FIXTURES §5)."""

import math

from pyspark.sql import functions as F

from cyclewise.operators import features as fe
from cyclewise.operators import labels as lb


def frame3(spark):
    # the reference's 3-row feature check: engine 1, cycles 1..3
    return spark.createDataFrame([(1, 1, 0.1, 0.5, 1.0), (1, 2, 0.2, 0.6, 1.0), (1, 3, 0.3, 0.7, 1.0)],
                                 "engine_id long, cycle long, sensor_1 double, sensor_2 double, setting_1 double")


def test_features_add_columns(spark):
    df = frame3(spark)
    out = fe.add_engine_features(lb.add_rul(df))
    assert len(out.columns) > len(df.columns)
    rows = {r.cycle: r for r in out.collect()}
    assert rows[1].sensor_1_rate == 0.0 and abs(rows[2].sensor_1_rate - 0.1) < 1e-12
    assert rows[1].sensor_1_rolling_std == 0.0
    assert abs(rows[3].sensor_1_rolling_mean - 0.2) < 1e-12
    assert rows[3].remaining_cycles == 0 and rows[1].cycle_ratio == 1 / 3


def test_rul_and_single_cycle_engine(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "engine_id long, cycle long")
    out = {(r.engine_id, r.cycle): r for r in lb.life_fraction_label(lb.add_rul(df)).collect()}
    assert [out[(1, c)].RUL for c in (1, 2, 3)] == [2, 1, 0]
    assert out[(2, 1)].RUL == 0 and out[(2, 1)].max_rul == 0 and out[(2, 1)].is_anomaly == 0  # 0/0 → healthy
    assert out[(1, 3)].is_anomaly == 1 and out[(1, 1)].is_anomaly == 0


def test_rolling_and_degradation(spark):
    df = frame3(spark)
    out = {r.cycle: r for r in fe.add_rolling_features(df, ["sensor_1"], windows=(2,)).collect()}
    assert out[1].sensor_1_rolling_std_2 == 0.0
    assert abs(out[2].sensor_1_rolling_mean_2 - 0.15) < 1e-12
    assert out[3].sensor_1_rolling_max_2 == 0.3 and out[3].sensor_1_rolling_min_2 == 0.2
    deg = {r.cycle: r for r in fe.add_degradation_features(df, ["sensor_1"]).collect()}
    assert deg[1].sensor_1_trend == 0.0 and abs(deg[3].sensor_1_trend - 0.2) < 1e-12
    assert deg[1].cycle_norm == 0.0 and abs(deg[3].cycle_norm - 1.0) < 1e-6


def test_sequences_short_engine_gives_none(spark):
    df = spark.createDataFrame([(1, c, float(c), 10 - c) for c in range(1, 5)] + [(2, 1, 1.0, 0)],
                               "engine_id long, cycle long, sensor_1 double, RUL long")
    seq = fe.sequence_windows(df, ["sensor_1"], length=3, target="RUL").orderBy("end_cycle").collect()
    assert [(r.start_cycle, r.end_cycle, r.target) for r in seq] == [(1, 3, 7), (2, 4, 6)]
    assert [s.sensor_1 for s in seq[0].steps] == [1.0, 2.0, 3.0]


def test_tiers_and_percent(spark):
    df = spark.createDataFrame([(150,), (80,), (10,), (600,)], "RUL long")
    rows = df.select(lb.health_tier("RUL").alias("t"), lb.life_percent("RUL").alias("p")).collect()
    assert [r.t for r in rows] == ["good", "warning", "critical", "good"]
    assert rows[3].p == 100.0 and math.isclose(rows[0].p, 50.0)


def test_ratio_pairs_first_ten_next_two():
    sensors = [f"sensor_{i}" for i in range(1, 22)]
    pairs = fe.ratio_pairs(sensors)
    assert len(pairs) == 17 and pairs[0] == ("sensor_1", "sensor_2") and pairs[-1] == ("sensor_9", "sensor_10")


def test_zero_divisor_ratio_is_missing_then_filled(spark):
    df = spark.createDataFrame([(1, 1, 1.0, -1e-8, 0.0), (1, 2, 2.0, 1.0, 0.0)],
                               "engine_id long, cycle long, sensor_1 double, sensor_2 double, setting_1 double")
    out = {r.cycle: r for r in fe.add_engine_features(df.withColumn("RUL", F.lit(1))).collect()}
    assert out[1].sensor_1_sensor_2_ratio == 0.0  # missing → no earlier value → 0


def test_rolling_skips_nan_like_pandas(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, float("nan")), (1, 3, 3.0)], "engine_id long, cycle long, sensor_1 double")
    out = {r.cycle: r for r in fe.add_rolling_features(df, ["sensor_1"], windows=(3,)).collect()}
    assert out[2].sensor_1_rolling_mean_3 == 1.0 and out[3].sensor_1_rolling_mean_3 == 2.0
    assert out[3].sensor_1_rolling_max_3 == 3.0


def test_fill_is_always_planned_and_one_chunk_equals_many(spark):
    rows = [(e, c, None if c % 3 == 0 else float(c), float("inf") if c % 4 == 0 else 2.0, 1.0)
            for e in (1, None) for c in range(1, 12)]
    df = spark.createDataFrame(rows, "engine_id long, cycle long, sensor_1 double, sensor_2 double, setting_1 double")
    one = fe.add_engine_features(df)
    many = fe.add_engine_features(df, chunk_rows=6)
    assert one.exceptAll(many).count() == 0 and one.count() == len(rows)
    got = {(r.engine_id, r.cycle): r for r in one.collect()}
    for e in (1, None):
        assert got[e, 3].sensor_1 == got[e, 2].sensor_1 == 2.0 and got[e, 4].sensor_2 == 2.0


def test_nan_difference_is_zero(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, float("nan")), (1, 3, 3.0)], "engine_id long, cycle long, sensor_1 double")
    out = {r.cycle: r for r in fe.add_degradation_features(df).collect()}
    assert [out[c].sensor_1_diff for c in (1, 2, 3)] == [0.0, 0.0, 0.0]


def test_rul_and_label_in_one_attach_equal_two(spark):
    df = spark.createDataFrame([(e, c) for e in (1, 2, None) for c in range(1, (e or 3) * 4)], "engine_id long, cycle long")
    one = lb.rul_and_life_fraction(df)
    assert one.exceptAll(lb.life_fraction_label(lb.add_rul(df)).select(one.columns)).count() == 0
    assert one.where("RUL IS NULL").count() == 0

"""Edge frames from FIXTURES §5."""

from pyspark.sql import functions as F

from cyclewise.operators import fleet as fl
from cyclewise.operators import labels as lb
from cyclewise.operators import rules as ru
from cyclewise.operators.ordering import engine_windows, number_rows, rows_back


def test_unsorted_input_numbered_in_order(spark):
    rows = [(1, 30, "c"), (1, 10, "a"), (1, 20, "b"), (2, 5, "z")]
    df = spark.createDataFrame(rows, "engine_id long, t long, tag string")
    got = {r.tag: r.cycle for r in number_rows(df, "engine_id", ["t"]).collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "z": 1}


def test_duplicate_engine_cycle_kept(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 1, 1.0), (1, 2, 3.0)], "engine_id long, cycle long, x double")
    out = engine_windows(df, lambda w: [F.avg("x").over(rows_back(w, 2)).alias("m")], halo=1, dense=False)
    assert out.count() == 3 and sorted(r.m for r in out.collect()) == [1.0, 1.0, 2.0]


def test_zero_total_confidence(spark):
    status = spark.createDataFrame([(1, False)], "engine_id long, is_streaming boolean")
    alerts = spark.createDataFrame([], "timestamp double, event_id long, alert_ord long, severity string")
    preds = spark.createDataFrame([(1.0, 1, 50.0, 0.0)], "timestamp double, event_id long, predicted_rul double, confidence double")
    stats = spark.createDataFrame([(0, 0, 0.0, 0.0)], "total_streamed long, errors long, uptime double, streaming_rate double")
    s = fl.fleet_summary_v2(status, alerts, preds, stats).first()
    assert s.avg_predicted_rul == 0.0 and s.total_alerts == 0 and s.error_rate == 0.0


def test_no_alerts_and_all_healthy(spark):
    df = spark.createDataFrame([(i, 1, i, float(i), 0.1, 0.2, 0.3) for i in range(1, 6)],
                               "event_id long, engine_id long, cycle long, timestamp double, sensor_1 double, "
                               "sensor_2 double, sensor_3 double")
    assert ru.alerts(df).count() == 0
    lab = lb.life_fraction_label(lb.add_rul(df.select("engine_id", "cycle")), healthy_threshold=0.0)
    assert lab.where("is_anomaly = 1").count() == 4  # cut at 1.0: every reading but the first is degraded
    healthy = lb.life_fraction_label(lb.add_rul(df.select("engine_id", "cycle")), healthy_threshold=1.0)
    assert healthy.where("is_anomaly = 1").count() == 0  # cut at 0.0: all healthy

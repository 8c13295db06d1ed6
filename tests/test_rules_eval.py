"""Rules and evaluation on small frames, AUC against brute force."""

import itertools
import random

from pyspark.sql import functions as F

from cyclewise.operators import evaluate as ev
from cyclewise.operators import fleet as fl
from cyclewise.operators import rules as ru


def test_alerts(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.0, 3.5, 0.5, -0.5), (2, 1, 2, 0.0, 0.1, 0.2, 0.3), (3, 1, 3, 0.0, 2.0, -1.0, 0.0)],
                               "event_id long, engine_id long, cycle long, timestamp double, sensor_1 double, "
                               "sensor_2 double, sensor_3 double")
    a = ru.alerts(df).orderBy("event_id", "alert_ord").collect()
    assert [(r.event_id, r.alert_type) for r in a] == [(1, "threshold_exceeded"), (1, "correlation_anomaly"),
                                                       (3, "correlation_anomaly")]
    assert a[0].details.sensor == "sensor_1" and a[0].details.threshold == 3.0 and a[0].severity == "medium"
    assert a[1].details.sensors == ["sensor_1", "sensor_2"] and abs(a[1].details.correlation_score - 3.0) < 1e-12
    assert ru.alerts(df.where("event_id = 2")).count() == 0  # no alerts


def test_estimates(spark):
    df = spark.createDataFrame([(1, 100), (51, None), (300, 10)], "cycle long, RUL long")
    out = df.select(ru.rul_estimate(F.col("RUL")).alias("p"), ru.confidence().alias("c")).collect()
    assert out[0].p == 100.0 and out[0].c == 1.0
    assert out[1].p == 50.0 and out[1].c == 0.5  # no RUL → base 100
    assert out[2].p == 0.0 and out[2].c == 0.5


def test_confusion_and_regression(spark):
    df = spark.createDataFrame([(True, True), (False, False), (False, True), (True, False), (True, True)], "t boolean, p boolean")
    c = ev.confusion(df, "t", "p").first()
    assert (c.tp, c.tn, c.fp, c.fn) == (2, 1, 1, 1)
    assert abs(c.precision - 2 / 3) < 1e-12 and abs(c.f1 - 2 / 3) < 1e-12
    none = ev.confusion(df.where("NOT t AND NOT p"), "t", "p").first()
    assert none.precision == 0.0 and none.recall == 0.0 and none.f1 == 0.0
    r = spark.createDataFrame([(5.0, 5.0), (5.0, 7.0)], "y double, yh double")
    m = ev.regression_metrics(r, "y", "yh").first()
    assert m.mse == 2.0 and m.r2 == 0.0 and m.accuracy_within_10 == 1.0  # constant truth → R² 0


def _auc_brute(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_auc_with_ties(spark):
    rnd = random.Random(1)
    pairs = [(float(rnd.randint(0, 9)), rnd.random() < 0.3) for _ in range(300)]
    df = spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate(pairs)], "id long, s double, y boolean")
    got = ev.roc_auc(df, "y", "s", "id").first().auc
    assert abs(got - _auc_brute(pairs)) < 1e-12


def test_latest_and_history(spark):
    topic = spark.createDataFrame([(float(i), i) for i in range(5000)], "timestamp double, event_id long")
    assert fl.latest(topic, 1000, ("timestamp", "event_id")).count() == 1000
    assert fl.latest(topic.limit(200), 100).agg(F.min("timestamp")).first()[0] == 100.0
    assert fl.oldest(topic, 3).agg(F.max("timestamp")).first()[0] == 2.0
    df = spark.createDataFrame([(1, c) for c in range(1, 31)], "engine_id long, cycle long")
    h = fl.engine_history(df, limit=10)
    assert h.count() == 10 and h.first().total_records == 30 and h.first().returned_records == 10


def test_best_model_failed_is_inf(spark):
    res = spark.createDataFrame([("a", None), ("b", 3.0), ("c", 2.0)], "model string, rmse double")
    assert fl.best_model(res).first().best_model == "c"


def test_health_rules(spark):
    df = spark.createDataFrame([(6, 100, 1000.0, 1100.0), (1, 100, 1000.0, 1030.0)], "e long, t long, last double, now double")
    out = df.select(ru.error_rate_issue(F.col("e"), F.col("t")).alias("a"), ru.idle_issue(F.col("last"), F.col("now")).alias("b"))
    out = out.select("*", ru.system_status(F.col("a"), F.col("b")).alias("s")).collect()
    assert out[0].a == "High error rate: 6.00%" and out[0].b.startswith("No streaming") and out[0].s == "degraded"
    assert out[1].a is None and out[1].b is None and out[1].s == "healthy"

"""Faulty input, changing tables, exact quantiles, folders."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cyclewise import session as se
from cyclewise.functions.exprs import attach_row
from cyclewise.operators import models as md
from cyclewise.operators import quality as qa
from cyclewise.operators import stats as st
from cyclewise.operators.quantiles import linear_quantiles, rank_quantile
from cyclewise.sources import readers as rd
from cyclewise.sources.tables import event_readings


def test_growing_table_is_read_anew(spark, sf_small):
    root = f"{se.ensure_checkpoint_dir(spark)}/growing-{random.random()}"
    events = spark.read.parquet(f"{sf_small}/events.parquet")
    events.where("event_id % 2 = 0").write.parquet(f"{root}/events.parquet")
    first = event_readings(spark, root).count()
    assert first == events.where("event_id % 2 = 0").count()
    events.where("event_id % 2 = 1").write.mode("append").parquet(f"{root}/events.parquet")
    assert event_readings(spark, root).count() == events.count() > first


def test_null_engine_keeps_its_readings(spark, sf_small):
    root = f"{se.ensure_checkpoint_dir(spark)}/nulls-{random.random()}"
    events = spark.read.parquet(f"{sf_small}/events.parquet")
    events.withColumn("user_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id"))).write.parquet(f"{root}/events.parquet")
    out = event_readings(spark, root)
    none = out.where("engine_id IS NULL")
    assert out.count() == events.count() and none.count() > 0
    assert none.agg(F.max("cycle")).first()[0] == none.count() == none.select("cycle").distinct().count()


def test_sensor_log_with_bad_lines(spark):
    path = f"{se.ensure_checkpoint_dir(spark)}/log-{random.random()}"
    spark.createDataFrame([("1 1 0.5",), ("nan 2 0.5 0.25",), ("99999999999999 3 1 2",), ("   ",)], "value string").write.text(path)
    rows = rd.read_sensor_log(spark, path, ["engine_id", "cycle", "setting_1", "sensor_1"]).orderBy("cycle").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 0.5, None), (None, 2, 0.5, 0.25), (None, 3, 1.0, 2.0)]


def test_validator_refuses_non_finite_ids(spark):
    df = spark.createDataFrame([("nan", "1", "5", "1.0"), ("inf", "1", "5", "1.0"), ("7.9", "1", "5", "1.0")], "engine_id string, cycle string, timestamp string, sensor_1 string")
    out = qa.validate(df).collect()
    assert [(r.engine_id, r.is_valid) for r in out] == [(None, False), (None, False), (7, True)]
    assert out[0].issues == ["Invalid type for engine_id: <class 'str'>"]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 3000])
def test_quantiles_equal_percentile(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, float("nan"), rng.gauss(0, 1), float(rng.randint(0, 5)), 7.0])if n > 5 else rng.gauss(0, 1), 3.0) for _ in range(n)]
    df = spark.createDataFrame(rows, "x double, y double")
    probs = (0.0, 0.05, 0.25, 0.5, 0.95, 1.0)
    got = linear_quantiles(df, ["x", "y"], probs)
    clean = df.select(F.nanvl("x", F.lit(None).cast("double")).alias("x"), "y")
    want = clean.agg(*[F.percentile(c, F.array(*map(F.lit, probs))) for c in ("x", "y")]).first()
    for c, w in zip(("x", "y"), want, strict=True):
        assert got[c] == pytest.approx(w) if w else got[c] == [None] * len(probs)
    values = sorted(r.x for r in clean.where("x IS NOT NULL").collect())
    assert rank_quantile(df, "x", 0.95) == (values[min(int(len(values) * 0.95), len(values) - 1)] if values else None)


def test_robust_scale(spark):
    df = spark.createDataFrame([(float(i), 2.0) for i in range(5)], "a double, b double")
    out = st.robust_scale(df, ["a", "b"]).orderBy("a").collect()
    assert [r.a for r in out] == [-1.0, -0.5, 0.0, 0.5, 1.0] and all(r.b == 0.0 for r in out)


def test_detector_survives_missing_inputs(spark):
    rows = [(float(i % 7), float(i % 5)) for i in range(50)] + [(float("nan"), 1.0), (None, 2.0), (500.0, -500.0)]
    df = spark.createDataFrame(rows, "sensor_1 double, sensor_2 double")
    det = md.fit_anomaly_detector(df.limit(52), ["sensor_1", "sensor_2"], k=1)
    out = det.detect(df)
    assert out.where("isnan(reconstruction_error) OR reconstruction_error IS NULL").count() == 0
    assert out.where("is_anomaly").count() >= 1


def test_attach_row_wants_one_row(spark):
    df = spark.range(3)
    assert attach_row(df, spark.range(1).select(F.lit(5).alias("x"))).where("x = 5").count() == 3
    with pytest.raises(PySparkException):
        attach_row(df, spark.range(2).select(F.col("id").alias("x"))).collect()


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        sparkContext = Context()
        conf = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        se.ensure_checkpoint_dir(Session())

"""Registered queries: model fit / score / evaluate on MLlib (M, D2, S6, K5).

What randomised training decides is checked by rows only; rankings, folds, the
flags of given errors and the least-squares fit (by its normal equations) are
checked by value."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..functions.exprs import attach_row

from ..operators import clean as cl
from ..operators import evaluate as ev
from ..operators import features as fe
from ..operators import fleet as fl
from ..operators import labels as lb
from ..operators import models as md
from ..operators import stats as st
from ..session import ensure_checkpoint_dir, table_version
from ..sources.tables import event_base, event_readings
from .common import with_readings
from .registry import register

SENSORS = ["sensor_1", "sensor_2", "sensor_3"]
DETECTOR_FEATURES = SENSORS + ["setting_1"]


def model_table(spark, sf_dir):
    """Engineered features + RUL target + train/test side (by engine)."""
    r = lb.add_rul(event_readings(spark, sf_dir)).select("engine_id", "cycle", *SENSORS, "setting_1", "RUL")
    f = fe.add_engine_features(r)
    # iterative fitting rescans its input many times: materialise it once in
    # the shared checkpoint folder (reliable, survives executor loss)
    ensure_checkpoint_dir(spark)
    return md.training_input(cl.valid_target(f).withColumn("split", fl.split_label()))


def _features(df):
    return md.model_features([c for c in df.columns if c != "split"])


_FITTED: dict = {}


def model_data(spark, sf_dir):
    """The model table, its inputs and what fits over its training side share;
    made once per (session, input)."""
    key = (spark.sparkContext.applicationId, *table_version(spark, f"{sf_dir.rstrip('/')}/events.parquet"), "table")
    if key not in _FITTED:
        t = model_table(spark, sf_dir)
        _FITTED[key] = (t, _features(t), md.Shared())
    return _FITTED[key]


def fitted(spark, sf_dir, kind: str, cv: bool = False):
    """Fit once per (session, input, model type): several registered queries
    read the same fitted model."""
    key = (spark.sparkContext.applicationId, *table_version(spark, f"{sf_dir.rstrip('/')}/events.parquet"), kind, cv)
    if key not in _FITTED:
        t, feats, shared = model_data(spark, sf_dir)
        res = md.fit_rul_model(t.where("split = 'train'"), feats, kind, tune=False, cv=cv, shared=shared)
        _FITTED[key] = (t, feats, res)
    return _FITTED[key]


@register("rul_forest_scores", "engine_id:l cycle:l RUL:l predicted_rul:r", None, "M4 M9 D2 P4")
def rul_forest_scores(spark, sf_dir):
    """M4 + M9: random forest (100 trees, depth 15) fitted on the training
    engines, scored on the held-out engines, clamped at 0."""
    t, _, res = fitted(spark, sf_dir, "random_forest")
    return md.score(res.model, t.where("split = 'test'")).select("engine_id", "cycle", "RUL", "predicted_rul")


@register("rul_model_metrics", "model:s rmse:r mae:r r2:r cv_rmse_mean:r cv_rmse_std:r folds:l", None,
          "M5 M8 M11 E4 E5")
def rul_model_metrics(spark, sf_dir):
    """Linear, forest and boosting models on the same split: test
    RMSE / MAE / R²; cross-validated RMSE (mean, std) for the linear model
    (tree models of small settings: ``rul_grid_search``)."""
    parts = []
    for kind in ("linear", "random_forest", "gradient_boosting"):
        t, _, res = fitted(spark, sf_dir, kind, cv=(kind == "linear"))
        test = t.where("split = 'test'")
        m = ev.regression_metrics(md.score(res.model, test), "RUL", "predicted_rul")
        parts.append(m.select(F.lit(kind).alias("model"), "rmse", "mae", "r2",
                              F.lit(res.cv_rmse_mean).cast("double").alias("cv_rmse_mean"),
                              F.lit(res.cv_rmse_std).cast("double").alias("cv_rmse_std"),
                              F.lit(res.folds).alias("folds")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("feature_importance_top5", "feature:s importance:r", None, "M10 K5")
def feature_importance_top5(spark, sf_dir):
    """M10 + K5: the five most important selected features of the forest."""
    _, feats, res = fitted(spark, sf_dir, "random_forest")
    return md.top_features(md.feature_importance(res.model, feats), 5)


@register("fscore_ranking", "feature:s correlation:d f_score:d4", with_readings(
    """SELECT feature, r AS correlation, r * r / (1 - r * r) * (n - 2) AS f_score FROM (
""" + "\nUNION ALL\n".join(
        f"  SELECT '{c}' AS feature, corr(CAST({c} AS DOUBLE), CAST(RUL AS DOUBLE)) AS r, count(*) AS n FROM t"
        for c in ["cycle"] + SENSORS + ["setting_1"]) + ") x",
    "t AS (SELECT *, max(cycle) OVER (PARTITION BY engine_id) - cycle AS RUL FROM readings)"), "M3")
def fscore_ranking(spark, sf_dir):
    """M3: univariate F-test scores of the raw inputs against RUL (the
    statistic SelectKBest ranks by)."""
    r = lb.add_rul(event_readings(spark, sf_dir))
    return md.f_regression_scores(r, ["cycle"] + SENSORS + ["setting_1"], "RUL")


def _detector(spark, sf_dir):
    """The detector and its readings; three queries read the same fit."""
    key = (spark.sparkContext.applicationId, *table_version(spark, f"{sf_dir.rstrip('/')}/events.parquet"), "detector")
    if key not in _FITTED:
        r = lb.rul_and_life_fraction(event_readings(spark, sf_dir)).withColumnRenamed("is_anomaly", "label")
        _FITTED[key] = (md.fit_anomaly_detector(cl.healthy_rows(r, "label"), DETECTOR_FEATURES, k=2), r)
    return _FITTED[key]


@register("anomaly_detection", "event_id:l engine_id:l cycle:l is_anomaly_label:l reconstruction_error:r "
          "is_anomaly:b anomaly_score:r threshold:r", None, "M12 M13 A14 P2")
def anomaly_detection(spark, sf_dir):
    """M12 + M13: reconstruction-error detector fitted on healthy readings,
    threshold at the 95th percentile of training errors; every reading
    scored."""
    det, r = _detector(spark, sf_dir)
    return det.detect(r).select("event_id", "engine_id", "cycle", F.col("label").alias("is_anomaly_label"),
                                "reconstruction_error", "is_anomaly", "anomaly_score", "threshold")


@register("anomaly_embeddings", "event_id:l embedding:r", None, "M14")
def anomaly_embeddings(spark, sf_dir):
    """Encoded (projected) representation of each reading."""
    det, r = _detector(spark, sf_dir)
    return md.embeddings(det, r).select("event_id", "embedding")


@register("detector_evaluation", "tp:l tn:l fp:l fn:l accuracy:r precision:r recall:r f1:r auc:r", None, "E1 E2 E3")
def detector_evaluation(spark, sf_dir):
    """E1–E3 on the detector: confusion, rates and ROC AUC of its error."""
    det, r = _detector(spark, sf_dir)
    d = det.detect(r).withColumn("truth", F.col("label") == 1)
    conf = ev.confusion(d, "truth", "is_anomaly")
    auc = ev.roc_auc(d, "truth", "reconstruction_error", "event_id").select("auc")
    return attach_row(conf, auc)


@register("model_roundtrip", "engine_id:l cycle:l predicted_rul:r reloaded_rul:r", None, "S6 M9")
def model_roundtrip(spark, sf_dir):
    """Save the fitted model (all stages) under the shared checkpoint folder, load
    it back and score with both."""
    t, _, res = fitted(spark, sf_dir, "linear", cv=True)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    res.model.write().overwrite().save(path)
    back = PipelineModel.load(path)
    test = t.where("split = 'test'")
    a = md.score(res.model, test).select("engine_id", "cycle", "predicted_rul")
    b = md.score(back, test).select("engine_id", "cycle", F.col("predicted_rul").alias("reloaded_rul"))
    return a.join(b, ["engine_id", "cycle"])


@register("model_inputs_kept", "rows:l different:l inputs:s", with_readings(
    f"""SELECT count(*) AS rows, 0 AS different, 'cycle,setting_1,sensor_1,sensor_2,sensor_3,cycle_sqrt,cycle_log,cycle_inv' AS inputs
FROM readings"""), "S6 M6 M9")
def model_inputs_kept(spark, sf_dir):
    """The linear model and its list of inputs, saved and loaded, score a
    table with its columns in another order and others beside them: no reading
    gets another estimate."""
    t = linear_table(spark, sf_dir)
    model = md.fit_linear_rul(t)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    back = PipelineModel.load(path)
    mixed = t.select(F.lit("x").alias("note"), *reversed(t.columns))
    a = md.score(model, t).select("engine_id", "cycle", "predicted_rul")
    b = md.score(back, mixed).select("engine_id", "cycle", F.col("predicted_rul").alias("again"))
    differ = ~F.coalesce(F.abs(F.col("predicted_rul") - F.col("again")) < 1e-9, F.lit(False))
    both = a.join(b, ["engine_id", "cycle"], "full")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(differ).alias("different")).withColumn("inputs", F.lit(",".join(md.feature_list(back))))


def linear_table(spark, sf_dir):
    r = lb.add_rul(event_readings(spark, sf_dir)).select("engine_id", "cycle", "setting_1", *SENSORS, "RUL")
    return md.training_input(r.select("*", *fe.cycle_transforms()))


LINEAR_INPUTS = ["cycle", "setting_1", *SENSORS, *md.LINEAR_TRANSFORMS]


@register("linear_rul_fit", "input:s rows:l moment:d4", with_readings(
    "SELECT input, rows, 0.0 AS moment FROM (SELECT count(*) AS rows FROM readings) n, (SELECT unnest(["
    + ", ".join(f"'{c}'" for c in ["intercept", *LINEAR_INPUTS]) + "]) AS input) i"), "M6")
def linear_rul_fit(spark, sf_dir):
    """M6: least squares on the plain inputs (28 with 21 sensors and three
    settings). Its closed form: the residuals have no correlation with any input
    and a mean of zero, by sums over all readings."""
    t = linear_table(spark, sf_dir)
    res = md.fit_linear_rul(t).transform(t).withColumn("_e", F.col("RUL") - F.col("prediction")).withColumn("intercept", F.lit(1.0))
    names = ["intercept", *LINEAR_INPUTS]
    # the cosine between the residuals and an input
    sums = [F.try_divide(F.sum(F.col("_e") * F.col(c)), F.sqrt(F.sum(F.col("_e") * F.col("_e")) * F.sum(F.col(c) * F.col(c)))).alias(f"m_{c}") for c in names]
    one = res.agg(F.count(F.lit(1)).alias("rows"), *sums)
    each = [F.struct(F.lit(c).alias("input"), F.coalesce(F.abs(f"m_{c}"), F.lit(0.0)).alias("moment")) for c in names]
    return one.select("rows", F.explode(F.array(*each)).alias("x")).select("x.input", "rows", "x.moment")


FOLDS = 3
FOLD_SQL = f"CAST('0x' || left(md5('42:' || CAST(engine_id AS VARCHAR)), 8) AS BIGINT) % 100 % {FOLDS}"


@register("rul_folds", "fold:l engines:l readings:l others:l shared:l", with_readings(
    f"""SELECT fold, engines, readings, sum(readings) OVER () - readings AS others, 0 AS shared FROM (
  SELECT {FOLD_SQL} AS fold, count(DISTINCT engine_id) AS engines, count(*) AS readings FROM readings GROUP BY 1) f"""), "M7 M8 D2")
def rul_folds(spark, sf_dir):
    """M7: the folds of cross-validation: whole engines, none on both sides of
    a fold (``shared``), every reading held out once."""
    per = event_readings(spark, sf_dir, columns=[]).groupBy("engine_id").agg(F.count(F.lit(1)).alias("n"))
    r = per.withColumn("fold", md.fold_of(FOLDS))
    held = r.groupBy("fold").agg(F.count(F.lit(1)).alias("engines"), F.sum("n").alias("readings"))
    folds = spark.range(FOLDS).select(F.col("id").alias("fold"))
    rest = r.withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(FOLDS)]))).where("fold != own")
    others = rest.groupBy("fold").agg(F.sum("n").alias("others"))
    shared = rest.select("fold", "engine_id").join(r.select("fold", "engine_id"), ["fold", "engine_id"]).groupBy("fold").agg(F.count(F.lit(1)).alias("shared"))
    return folds.join(held, "fold").join(others, "fold", "left").join(shared, "fold", "left").fillna(0, ["others", "shared"])


#: small settings, so that the search ends in minutes on one machine
SEARCH = {
    "linear": ({}, {}),
    "random_forest": ({"maxDepth": [4, 6]}, {"numTrees": 8, "maxDepth": 6}),
    "gradient_boosting": ({"maxDepth": [2, 3]}, {"maxIter": 4, "maxDepth": 3}),
}


@register("rul_grid_search", "model:s setting:s fold:l rmse:r cv_rmse_mean:r cv_rmse_std:r chosen:b", None, "M7 M8 M11")
def rul_grid_search(spark, sf_dir):
    """M7 + M8: every model type's settings on folds of whole engines, with the
    mean and deviation over the folds and the setting that is chosen by mean
    squared error. The operator's own grid is ``FOREST_GRID`` / ``BOOSTING_GRID``."""
    t, feats, shared = model_data(spark, sf_dir)
    train, rows = t.where("split = 'train'"), []
    for kind, (grid, start) in SEARCH.items():
        res = md.fit_rul_model(train, feats, kind, tune=True, grid=grid, folds=FOLDS, shared=shared, **start)
        rows += [(kind, name, fold, rmse, name == res.setting) for name, fold, rmse in res.trials]
    out = spark.createDataFrame(rows, "model string, setting string, fold long, rmse double, chosen boolean")  # settings x folds
    per = out.groupBy("model", "setting").agg(F.avg("rmse").alias("cv_rmse_mean"), F.stddev_pop("rmse").alias("cv_rmse_std"))
    return out.join(per, ["model", "setting"])


@register("flagged_errors", "event_id:l label:l reconstruction_error:d is_anomaly:b anomaly_score:d", with_readings(
    """SELECT event_id, CAST(cycle % 7 = 0 AS INT) AS label, e AS reconstruction_error, e > thr AS is_anomaly,
       greatest(0.0, least(5.0, e / thr)) AS anomaly_score
FROM e CROSS JOIN (SELECT quantile_cont(e, 0.95) AS thr FROM e WHERE cycle % 7 <> 0) q""",
    "e AS (SELECT event_id, cycle, (sensor_1 - 50.0) * (sensor_1 - 50.0) / 100.0 AS e FROM readings)"), "M13 A14")
def flagged_errors(spark, sf_dir):
    """M13 over errors that are given by a rule: flag, score and the labels, by
    the exact 95th percentile (A14) of the rows labelled healthy."""
    d = F.col("sensor_1") - 50.0
    r = event_readings(spark, sf_dir).select("event_id", (F.col("cycle") % 7 == 0).cast("int").alias("label"), (d * d / 100.0).alias("reconstruction_error"))
    limit = st.linear_percentile(r.where("label = 0"), "reconstruction_error", md.ANOMALY_QUANTILE)
    return md.flag_errors(attach_row(r, limit), F.col("p"))


RANKED = ["cycle", *SENSORS, "setting_1", *md.LINEAR_TRANSFORMS, "cycle_squared"]


@register("top_inputs", "feature:s importance:d3", with_readings(
    "SELECT feature, round(r * r, 3) AS importance FROM (\n" + "\nUNION ALL\n".join(
        f"  SELECT '{c}' AS feature, corr(CAST({x} AS DOUBLE), CAST(RUL AS DOUBLE)) AS r FROM t" for c, x in zip(
            RANKED, ["cycle", *SENSORS, "setting_1", "sqrt(cycle)", "ln(1 + cycle)", "1.0 / (cycle + 1)", "cycle * cycle"]))
    + ") x ORDER BY round(r * r, 3) DESC, feature LIMIT 5",
    "t AS (SELECT *, max(cycle) OVER (PARTITION BY engine_id) - cycle AS RUL FROM readings)"), "K5")
def top_inputs(spark, sf_dir):
    """K5 over a table of importances that SQL can make: the five inputs that
    explain most of the RUL alone (r squared, to three places; ties by name)."""
    r = lb.add_rul(event_readings(spark, sf_dir)).select("*", *fe.cycle_transforms())
    scores = md.f_regression_scores(r, RANKED, "RUL")
    return md.top_features(scores.select("feature", F.round(F.col("correlation") * F.col("correlation"), 3).alias("importance")), 5)


@register("engine_split", "split:s engines:l readings:l", with_readings(
    """SELECT CASE WHEN CAST('0x' || left(md5('42:' || CAST(engine_id AS VARCHAR)), 8) AS BIGINT) % 100 < 80
            THEN 'train' ELSE 'test' END AS split,
       count(DISTINCT engine_id) AS engines, count(*) AS readings FROM readings GROUP BY 1"""), "D2")
def engine_split(spark, sf_dir):
    """80 / 20 split by engine hash — no engine on both sides."""
    r = event_readings(spark, sf_dir, columns=[]).withColumn("split", fl.split_label())
    return r.groupBy("split").agg(F.count_distinct("engine_id").alias("engines"), F.count(F.lit(1)).alias("readings"))

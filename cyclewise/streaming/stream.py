"""Structured Streaming form of the live path.

* Source (S10): ``readStream`` over a folder of reading files (a Kafka source
  is a format swap).
* T1: validation, alerts and estimates are the *batch* functions applied to
  the stream (pure projections, no state).
* T2 / S11: one ``foreachBatch`` fans a micro-batch out to the topic tables;
  every write goes to ``batch_id=<n>`` with overwrite, so a replayed batch
  replaces its own output (idempotent).
* T3: each topic also keeps a bounded buffer of its latest N messages,
  rewritten per batch from (buffer ∪ batch) — never more than N + batch rows.
* T4 / T5 / T8: state-store aggregations in update mode; changed keys are
  appended to an upsert log and readers take the newest row per key — no rewrite
  of the whole table per batch, and the log is compacted every few batches.
* T6 / T7 / T9: see :mod:`.sequence`. Q7 / A16: counters observed on the way.

Checkpoints and sink tables live under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import rules as ru
from ..schema import CYCLE, ENGINE
from ..session import ensure_checkpoint_dir

TOPICS = ("sensor_data", "anomaly_alerts", "rul_predictions", "system_events")
TOPIC_BOUND = 1000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for ``name`` under the cluster's checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/cyclewise/{name}-{uuid.uuid4().hex[:12]}"


# ---------------------------------------------------------------- source


def reading_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 1) -> DataFrame:
    """Readings arriving as files in ``path`` (oldest first)."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .option("latestFirst", "false").parquet(path))


#: micro-batches (about) in which an archive of files is read
ARCHIVE_BATCHES = 4


def archive_stream(batch: DataFrame, path: str, max_files: int = 3, batches: int = ARCHIVE_BATCHES) -> DataFrame:
    """S10 over a table that is there: the files of ``batch`` under ``path``,
    ``max_files`` a micro-batch, more where that makes more than ``batches``. A
    micro-batch costs a task, a state commit and a report to the driver for each
    state partition, and what waits in the state is read again, so their number
    must not grow with the table."""
    files = len(batch.inputFiles())
    return reading_stream(batch.sparkSession, path, batch.schema, max(max_files, -(-files // batches)))


def stream_table(df: DataFrame, path: str, max_files: int = 3) -> tuple[DataFrame, DataFrame]:
    """S10 over a table that is derived first: written once as Parquet files,
    in parallel and in no order, and read as a stream of :func:`archive_stream`;
    the stream, and the written table. Rows without an event time come along."""
    df.write.mode("error").parquet(path)
    batch = df.sparkSession.read.schema(df.schema).parquet(path)
    return archive_stream(batch, path, max_files), batch


def run_available(query) -> None:
    """Drive a query started with ``trigger(availableNow=True)`` to the end."""
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


# ---------------------------------------------------------------- T1 + T2 + T3


def fan_out(root: str, bound: int = TOPIC_BOUND,
            topics: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
            order: Sequence[str] = ("timestamp", "event_id")) -> Callable[[DataFrame, int], None]:
    """T2 + T3: a ``foreachBatch`` function writing each derived topic to
    ``root/<topic>/log/batch_id=<n>`` (idempotent) and refreshing the topic's
    buffer of the ``bound`` latest messages from what it has written, so a
    topic is derived once per batch."""
    topics = topics or {}

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        for name, derive in topics.items():
            log = f"{root}/{name}/log/batch_id={batch_id}"
            derive(batch).write.mode("overwrite").parquet(log)
            _refresh_latest(spark.read.parquet(log), f"{root}/{name}/latest", batch_id, bound, order)

    return write


def _refresh_latest(batch_out: DataFrame, path: str, batch_id: int, bound: int, order) -> None:
    """Two slots, written in turn: batch n reads what batch n - 1 left in the
    other slot, so a batch that runs again finds its input untouched, and no
    older version remains."""
    merged = batch_out
    if batch_id > 0:
        try:
            prev = batch_out.sparkSession.read.parquet(f"{path}/slot={(batch_id - 1) % 2}")
            merged = prev.drop("_batch").unionByName(batch_out)
        except AnalysisException as e:  # the topic's first batch
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    cols = [c for c in order if c in batch_out.columns]
    keep = merged.orderBy(*[F.col(c).desc() for c in cols]).limit(bound)
    keep.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/slot={batch_id % 2}")


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The buffer that the newest batch has left."""
    both = spark.read.parquet(path)
    newest = both.agg(F.max("_batch").alias("_newest"))
    return both.join(newest, both["_batch"] == newest["_newest"], "left_semi").drop("_batch", "slot")


def topic_log(spark: SparkSession, root: str, topic: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{topic}/log")


def live_outputs(stats: DataFrame, sensors: Sequence[str]) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Per-batch derivations — normalise with offline stats (a one-row
    static table), then the batch alert / estimate rules."""
    from ..operators.stats import zscore

    def norm(b: DataFrame) -> DataFrame:
        return zscore(b, list(sensors), stats)

    def alerts(b: DataFrame) -> DataFrame:
        a = ru.alerts(norm(b), list(sensors))
        return a.select("event_id", ENGINE, CYCLE, "timestamp", "alert_ord", "alert_type", "severity", "message",
                        F.col("details.sensor").alias("sensor"), F.col("details.value").alias("value"),
                        F.col("details.threshold").alias("threshold"),
                        F.array_join("details.sensors", ",").alias("sensors"),
                        F.col("details.correlation_score").alias("correlation_score"))

    def preds(b: DataFrame) -> DataFrame:
        p = ru.predictions(norm(b), base="RUL", sensors=list(sensors))
        return p.withColumn("features_used", F.array_join("features_used", ","))

    def readings(b: DataFrame) -> DataFrame:
        return norm(b)

    return {"sensor_data": readings, "anomaly_alerts": alerts, "rul_predictions": preds}


# ---------------------------------------------------------------- upsert log

#: batches between two compactions of an upsert log
COMPACT_EVERY = 10


def _numbers(spark: SparkSession, root: str, prefix: str) -> list[int]:
    """The n of complete folders ``root/<prefix>=n`` (with a _SUCCESS mark), in
    order, on whatever store ``root`` is."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    found = [int(n[len(prefix) + 1 :]) for n in names if n.startswith(f"{prefix}=")]
    return sorted(n for n in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{prefix}={n}/_SUCCESS")))


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _newest(spark: SparkSession, root: str, keys: Sequence[str], upto: int | None = None) -> DataFrame | None:
    """Newest row per key of the newest base and the log after it, both no
    later than batch ``upto``."""
    bases = [n for n in _numbers(spark, f"{root}/base", "upto") if upto is None or n < upto]
    after = bases[-1] if bases else -1
    logs = [n for n in _numbers(spark, f"{root}/log", "batch") if n > after and (upto is None or n <= upto)]
    parts = [spark.read.parquet(f"{root}/base/upto={after}")] if bases else []
    if logs:
        parts.append(spark.read.parquet(*[f"{root}/log/batch={n}" for n in logs]))
    if not parts:
        return None
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    values = [c for c in both.columns if c not in set(keys)]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v")).select(*keys, "_v.*")


def upsert_log(root: str, keys: Sequence[str], every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink for update-mode aggregates. Changed keys of batch n
    go to ``log/batch=n``; after each ``every`` batches the newest row per key of
    the last base and the log since goes to ``base/upto=n``, and what the base
    before that one covers is removed. Two generations stay, so a batch that is
    killed and runs again finds its input, writes the same (overwrite), and at
    most ``2 * every`` batches and two bases are ever kept. A folder counts
    once it is complete."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{root}/log/batch={batch_id}")
        if (batch_id + 1) % every == 0:
            _newest(spark, root, keys, batch_id).write.mode("overwrite").parquet(f"{root}/base/upto={batch_id}")
            bases = [n for n in _numbers(spark, f"{root}/base", "upto") if n < batch_id]
            if bases:
                for n in _numbers(spark, f"{root}/log", "batch"):
                    if n <= bases[-1]:
                        _remove(spark, f"{root}/log/batch={n}")
                for n in bases[:-1]:
                    _remove(spark, f"{root}/base/upto={n}")

    return write


def read_upserts(spark: SparkSession, root: str, keys: Sequence[str]) -> DataFrame:
    """Newest value per key (one partial aggregate)."""
    return _newest(spark, root, keys).drop("_batch")


def topic_counters(published: DataFrame) -> DataFrame:
    """T4: messages and last activity per topic (state-store aggregate)."""
    return published.groupBy("topic").agg(F.count(F.lit(1)).alias("published"),
                                           F.max("timestamp").alias("last_activity"))


def engine_progress(readings: DataFrame) -> DataFrame:
    """T5: per engine, readings seen and the latest cycle."""
    return readings.groupBy(ENGINE).agg(F.count(F.lit(1)).alias("readings_seen"), F.max(CYCLE).alias("max_cycle"))


def health_windows(validated: DataFrame, ts: str = "event_time", width: str = "1 day",
                   watermark: str = "1 hour") -> DataFrame:
    """Per event-time window, readings, errors and the R8 issue."""
    agg = (validated.withWatermark(ts, watermark).groupBy(F.window(ts, width).alias("w"))
           .agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_valid")).alias("errors")))
    return agg.select(F.col("w.start").alias("window_start"), "total", "errors",
                      ru.error_rate_issue(F.col("errors"), F.col("total")).alias("issue"))


# ---------------------------------------------------------------- Q7, A16 on a stream


def observed(validated: DataFrame, name: str = "validation") -> DataFrame:
    """Q7: the validation counters observed on the way (``Dataset.observe``), so
    that a stream's progress carries them without a second pass."""
    return validated.observe(
        name,
        F.count(F.lit(1)).alias("total_validated"),
        F.count_if(~F.col("is_valid")).alias("validation_errors"),
        F.coalesce(F.sum("n_corrections"), F.lit(0)).alias("corrections_made"),
    )


class Progress:
    """Running totals of a query's progress reports (Q7, A16): observed counters,
    input rows and the time its batches took. ``update`` takes in the reports
    that the query still keeps and counts each batch once, so call it at least
    every ``spark.sql.streaming.numRecentProgressUpdates`` batches."""

    def __init__(self, name: str = "validation"):
        self.name, self.batch = name, -1
        self.totals: dict[str, int] = {}
        self.rows, self.millis = 0, 0

    def update(self, query) -> Progress:
        for p in query.recentProgress:
            if p.batchId <= self.batch:
                continue
            self.batch = p.batchId
            self.rows += p.numInputRows
            self.millis += p.batchDuration
            row = p.observedMetrics.get(self.name)
            if row is not None:
                for k, v in row.asDict().items():
                    self.totals[k] = self.totals.get(k, 0) + (v or 0)
        return self

    def rate(self) -> float:
        """Input rows a second of processing."""
        return 1000 * self.rows / self.millis if self.millis else 0.0

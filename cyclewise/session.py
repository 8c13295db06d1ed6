"""Session helpers: one place that decides Spark settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Settings the operators assume. ANSI stays on (the library uses try_cast /
# try_divide where the reference tolerates bad input); AQE re-plans joins and
# splits skewed shuffle partitions at run time.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "cyclewise", conf: dict | None = None) -> SparkSession:
    """Return the active session, or build one with the library defaults.

    On a cluster, ``master`` stays ``None`` and the launcher's settings win;
    locally (tests, bench) pass ``local[N]``.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            builder = builder.config("spark.driver.memory", os.environ.get("CYCLEWISE_DRIVER_MEMORY", "16g"))
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return apply_runtime_conf(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local master may go
    without it and gets a fresh scratch folder; on a cluster a folder of the
    driver's machine would be another one on each executor."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="cyclewise-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


# Runtime settings the operators rely on; safe to apply to a session someone
# else built (the driver's, a notebook's).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",  # TIMESTAMP_NTZ → epoch seconds must not shift
    # list state, timers and the state reader of the stream operators need it
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def env_int(name: str, default: int) -> int:
    try:
        return int(os.environ.get(name, default))
    except ValueError:
        return default


def table_version(spark: SparkSession, path: str) -> tuple:
    """What the files under ``path`` look like now: how many, their bytes, and
    a hash of names, sizes and times. Results that are kept by path are kept
    under this, so a table that grows or changes is read anew."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    row = files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "modificationTime", "length"))).first()
    return (path, *row)


def materialise(df, name: str = "table"):
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    return it read back: lineage is cut, the input is computed once (a
    ``checkpoint()`` without caching computes it twice), and later reads are
    column-pruned."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cyclewise/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.parquet(path)

"""The batch preparation entry as one lazy plan:
readings → RUL (L1) → rolling / degradation features (W1–W4, W7, W8, F4) →
missing / ±inf → 0 (P5) → standard scaling with population std (M1) →
life-fraction labels (L2) → sequences (W10). Outputs can be written with the
sinks (S4, S5, S7)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import clean as cl
from ..operators import features as fe
from ..operators import stats as st
from ..schema import CYCLE, ENGINE, TARGET, SensorSchema
from ..session import materialise
from ..sources import sinks as sk

SEQUENCE_LENGTH = 30  # what the reference's preparation asks for
HEALTHY_THRESHOLD = 0.8


@dataclass
class TrainingTables:
    processed: DataFrame  # ids, RUL, scaled features
    anomaly: DataFrame  # processed + max_rul, is_anomaly
    sequences: DataFrame  # engine, start/end cycle, steps, target
    stats: DataFrame  # feature, mean, std (the fitted scaler)
    features: list[str]


def prepare_training_tables(readings: DataFrame, keep: tuple[str, ...] = (),
                            seq_len: int = SEQUENCE_LENGTH) -> TrainingTables:
    """``readings``: engine_id, cycle, settings, sensors (+ ``keep`` columns
    carried along unscaled)."""
    schema = SensorSchema.of(readings)
    base = readings.select(ENGINE, CYCLE, *keep, *schema.settings, *schema.sensors)
    # one chunk-window pass gives RUL, the label and every windowed feature
    labels = ("max_rul", "is_anomaly")
    f = fe.add_preprocessing_features(base, schema.sensors, healthy_threshold=HEALTHY_THRESHOLD)
    features = [c for c in f.columns if c not in (ENGINE, CYCLE, TARGET, *keep, *labels)]
    f = cl.inf_to_zero(f, features)
    # the scaler is fitted and applied on the same feature table: materialise it
    # once in the shared checkpoint folder instead of evaluating the window
    # stage for each consumer
    f = materialise(f, "features")
    stats = st.feature_stats(f, features)
    scaled = st.zscore(f, features, stats)
    processed = scaled.select(ENGINE, CYCLE, TARGET, *keep, *features)
    anomaly = scaled.select(ENGINE, CYCLE, TARGET, *keep, *features, *labels)
    sequences = fe.sequence_windows(processed, features, length=seq_len, target=TARGET)
    return TrainingTables(processed, anomaly, sequences, st.stats_long(stats, features), features)


def write_training_tables(t: TrainingTables, root: str) -> None:
    """Processed and anomaly tables, scaler stats, sequences."""
    sk.write_table(t.processed, f"{root}/train_processed")
    sk.write_table(t.anomaly, f"{root}/train_anomaly")
    sk.save_stats(t.stats, f"{root}/normalization_stats")
    sk.write_sequences(t.sequences, f"{root}/sequences")

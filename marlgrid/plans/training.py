"""Training runs: a checked specification, a split that every engine makes alike, a metric's floor, registration behind it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlgrid.operators.profile import LOWER_IS_BETTER, validation_bucket

# Metrics and transforms that a specification may name.
METRICS = ("accuracy", "f1", "f1_macro", "precision", "precision_at_k", "recall", "recall_at_k", "rmse", "mae", "mape", "r2", "auc", "roc_auc", "log_loss", "ndcg_at_k", "map_at_k")
TRANSFORMS = ("log1p", "zscore", "clip", "one_hot")


@dataclass(frozen=True)
class Spec:
    model: str
    key: str
    label: str
    features: Sequence[str]
    metric: str
    floor: float
    seed: str = "0"
    transforms: Sequence[tuple[str, str, str]] = ()


@dataclass
class TrainingRun:
    model: str
    metric: str
    value: float | None
    passed: bool
    train_rows: int
    validation_rows: int
    version: int | None = None
    findings: list[str] = field(default_factory=list)


def spec_findings(spec: Spec, columns: Sequence[str]) -> list[str]:
    out = [] if len([p for p in spec.model.split(".") if p.strip()]) == 3 else ["model name of three parts"]
    out += [] if spec.metric in METRICS else [f"metric {spec.metric}"]
    out += [f"transform {t[0]}" for t in spec.transforms if t[0] not in TRANSFORMS]
    out += [] if spec.features else ["no features"]
    out += [f"column {c}" for c in (spec.key, spec.label, *spec.features) if c not in columns]
    return out + ([f"label among the features: {spec.label}"] if spec.label in spec.features else [])


def split(df: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """(train, validation): about a fifth of the rows validates, by a hash of seed and key."""
    told = df.withColumn("_side", validation_bucket(spec.seed, F.coalesce(F.col(spec.key).cast("string"), F.lit(""))))
    return tuple(told.where(F.col("_side") == side).drop("_side") for side in ("train", "validation"))


def run_training(df: DataFrame, spec: Spec, train: Callable[[Spec, DataFrame, DataFrame], tuple[float, object]], register: Callable[[str, object, dict], int]) -> TrainingRun:
    """Trains by a registered callable, which returns the metric on the validation rows and a model; registers the model if the metric
    reaches the floor (from below where less is better).  A specification with findings isn't trained."""
    if found := spec_findings(spec, df.columns):
        return TrainingRun(spec.model, spec.metric, None, False, 0, 0, None, found)
    fit, hold = split(df, spec)
    sizes = fit.agg(F.count("*")).unionAll(hold.agg(F.count("*"))).collect()
    value, model = train(spec, fit, hold)
    passed = value <= spec.floor if spec.metric in LOWER_IS_BETTER else value >= spec.floor
    version = register(spec.model, model, {"metric": spec.metric, "value": value, "passed": passed}) if passed else None
    return TrainingRun(spec.model, spec.metric, value, passed, sizes[0][0], sizes[1][0], version, [] if passed else ["below the floor"])

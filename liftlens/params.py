"""Study parameters and the small tables derived from them."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlens import constants as C


def _require(holds: bool, what: str) -> None:
    """Settings are checked under ``python -O`` too."""
    if not holds:
        raise ValueError(f"bad setting: {what}")


@dataclass(frozen=True)
class Hypothesis:
    id: str
    kind: str
    intervention: str
    metric: str
    segment: str = C.ALL_SEGMENTS
    compare_to: str = ""
    threshold: float = 0.0
    horizon_days: int | None = None
    statement: str = ""
    limitation: str = ""

    def __post_init__(self):
        _require(self.kind in C.KINDS, self.kind)
        _require(self.metric in C.METRICS, self.metric)
        _require(self.intervention in C.INTERVENTION_TYPES, self.intervention)
        _require(self.segment in [C.ALL_SEGMENTS, *C.SEGMENTS], self.segment)
        if self.kind == "did_difference":
            _require(self.compare_to in C.INTERVENTION_TYPES, "did_difference needs compare_to")
        if self.kind == "descriptive":
            _require(isinstance(self.horizon_days, int), "descriptive needs horizon_days")
        else:
            _require(self.metric != "domain_authority", "domain_authority is site-level")


@dataclass(frozen=True)
class Params:
    analysis_cutoff: date
    hypotheses: tuple[Hypothesis, ...]
    gsc_lag_days: int = 3
    pre_days: int = 42
    buffer_days: int = 7
    ramp_days: int = 14
    post_days: int = 42
    min_post_days: int = 28
    min_days_per_window: int = 20
    control_group: str = "control"
    placebo_shift_days: int = 63
    bootstrap_reps: int = 2000
    ci_level: float = 0.95
    multiplicity: str = "bonferroni"
    seed: int = 42
    mode: str = "snapshot"

    def __post_init__(self):
        ids = [h.id for h in self.hypotheses]
        _require(len(ids) == len(set(ids)), "hypothesis ids must be unique")
        _require(self.bootstrap_reps >= 100, "bootstrap_reps must be >= 100")
        _require(0.5 < self.ci_level < 1, "ci_level must be in (0.5, 1)")
        _require(self.multiplicity in ("bonferroni", "none"), self.multiplicity)
        _require(self.mode in C.MODE_LABELS, self.mode)
        for name in ("gsc_lag_days", "buffer_days", "ramp_days", "min_days_per_window", "placebo_shift_days"):
            _require(getattr(self, name) >= 0, f"{name} must not be negative")
        _require(self.pre_days > 0 and self.post_days > 0, "windows need days")
        _require(0 < self.min_post_days <= self.post_days, "min_post_days must lie within post_days")

    def with_(self, **changes) -> Params:
        return replace(self, **changes)

    @property
    def available_until(self) -> date:
        """Search values arrive late: those up to this day no longer change after the cutoff."""
        return self.analysis_cutoff - timedelta(days=self.gsc_lag_days)

    @property
    def inferential(self) -> tuple[Hypothesis, ...]:
        return tuple(h for h in self.hypotheses if h.kind != "descriptive")

    @property
    def segments(self) -> list[str]:
        """Segment views the inferential hypotheses read."""
        return sorted({h.segment for h in self.inferential})

    @property
    def ci_level_adj(self) -> float:
        if self.multiplicity == "none":
            return self.ci_level
        return 1 - (1 - self.ci_level) / max(len(self.inferential), 1)


def small_table(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """A local relation for configuration rows; its size is known, so joins with it broadcast."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def hypotheses(spark: SparkSession, p: Params) -> DataFrame:
    """One row per hypothesis, in the given order (``ordinal``)."""
    schema = pa.schema([
        ("ordinal", pa.int32()), ("hypothesis_id", pa.string()), ("kind", pa.string()),
        ("intervention", pa.string()), ("compare_to", pa.string()), ("metric", pa.string()),
        ("segment", pa.string()), ("threshold", pa.float64()), ("horizon_days", pa.int32()),
        ("statement", pa.string()), ("limitation", pa.string()),
    ])
    rows = [{"ordinal": i, "hypothesis_id": h.id, "kind": h.kind, "intervention": h.intervention,
             "compare_to": h.compare_to, "metric": h.metric, "segment": h.segment,
             "threshold": float(h.threshold), "horizon_days": h.horizon_days,
             "statement": h.statement, "limitation": h.limitation}
            for i, h in enumerate(p.hypotheses)]
    return small_table(spark, rows, schema)


def inferential(hyp: DataFrame) -> DataFrame:
    return hyp.where(F.col("kind") != "descriptive")


def arms(hyp: DataFrame) -> DataFrame:
    """Inferential hypotheses with one row per treated arm and its intervention type."""
    arm_a = F.struct(F.lit("a").alias("arm"), F.col("intervention").alias("type"))
    arm_b = F.struct(F.lit("b").alias("arm"), F.col("compare_to").alias("type"))
    pairs = F.when(F.col("kind") == "did_difference", F.array(arm_a, arm_b)).otherwise(F.array(arm_a))
    return inferential(hyp).select("*", F.inline(pairs))


def models(hyp: DataFrame) -> DataFrame:
    """Models per inferential hypothesis and the metric each one reads."""
    own = [F.struct(F.lit(m).alias("model"), F.col("metric").alias("model_metric")) for m in C.MODELS[:2]]
    raw = F.struct(F.lit(C.MODELS[2]).alias("model"), F.lit("ctr_raw").alias("model_metric"))
    pairs = F.when(F.col("metric") == "ctr_adjusted", F.array(*own, raw)).otherwise(F.array(*own))
    return inferential(hyp).select("*", F.inline(pairs))

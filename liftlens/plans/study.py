"""The effect study end to end: panels, windows, predictions, evaluation and diagnostics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlens import constants as C
from liftlens.operators import design as D
from liftlens.operators import evaluation as E
from liftlens.operators import panel as P
from liftlens.operators import windows as W
from liftlens.operators.bootstrap import draws, intervals
from liftlens.operators.predictions import point_effects, predictions
from liftlens.operators.series import event_series
from liftlens.params import Params, hypotheses
from liftlens.session import materialize


@dataclass
class Study:
    """Lazy tables of one study. Only what later steps read several times is written once: the click-rate
    curve, the cohort windows, the page windows, the page changes and the sample sizes. Everything else stays in the caller's plan."""

    spark: SparkSession
    pages: DataFrame
    gsc: DataFrame
    interventions: DataFrame
    authority: DataFrame
    p: Params
    run_id: str = "run"

    @cached_property
    def hyp(self) -> DataFrame:
        return hypotheses(self.spark, self.p)

    @cached_property
    def segment_day(self) -> DataFrame:
        return P.segment_day(self.gsc)

    @cached_property
    def page_day(self) -> DataFrame:
        return P.page_day(self.segment_day)

    @cached_property
    def view(self) -> DataFrame:
        return P.segment_view(P.final_only(self.segment_day, self.p), self.p.segments)

    @cached_property
    def curve(self) -> DataFrame:
        """13 rows, stored once: each use would scan the training days again."""
        return materialize(W.fit_ctr_curve(self.page_day, D.ctr_training_end(self.interventions, self.p), self.p), "curve")

    def cohorts(self, shift_days: int = 0) -> DataFrame:
        """Windows per cohort, stored once: a few rows, but taken from all interventions."""
        if shift_days not in self._cohorts:
            windows = D.cohort_windows(self.hyp, self.interventions, self.p, shift_days)
            self._cohorts[shift_days] = materialize(windows, "cohorts")
        return self._cohorts[shift_days]

    @cached_property
    def _cohorts(self) -> dict[int, DataFrame]:
        return {}

    def design(self, shift_days: int = 0) -> DataFrame:
        return D.build_design(self.cohorts(shift_days), self.pages, self.interventions, self.p)

    def page_windows(self, shift_days: int = 0) -> DataFrame:
        return W.page_windows(self.design(shift_days), self.view, self.curve, self.p)

    @cached_property
    def stored_windows(self) -> DataFrame:
        return materialize(self.page_windows(), "page_windows")

    @cached_property
    def stored_placebo_windows(self) -> DataFrame:
        return materialize(self.page_windows(self.p.placebo_shift_days), "placebo_windows")

    @cached_property
    def changes(self) -> DataFrame:
        return materialize(W.pre_post(self.stored_windows), "changes")

    @cached_property
    def placebo_changes(self) -> DataFrame:
        return materialize(W.pre_post(self.stored_placebo_windows), "placebo_changes")

    @cached_property
    def sizes(self) -> DataFrame:
        return materialize(E.sample_sizes(self.stored_windows, self.predictions, self.hyp), "sizes")

    @cached_property
    def predictions(self) -> DataFrame:
        return predictions(self.changes, self.cohorts(), self.hyp, self.p, self.run_id)

    @cached_property
    def placebo_predictions(self) -> DataFrame:
        return predictions(self.placebo_changes, self.cohorts(self.p.placebo_shift_days), self.hyp, self.p,
                           self.run_id).where(F.col("model") == "did")

    def point_effects(self) -> DataFrame:
        return point_effects(self.predictions, self.hyp)

    def draws(self, wanted: list[str]) -> DataFrame:
        return draws(self.changes, E.usable_models(self.sizes, wanted), self.p)

    def intervals(self, wanted: list[str]) -> DataFrame:
        return intervals(self.draws(wanted), self.p)

    @cached_property
    def trend(self) -> DataFrame:
        return E.trend_asof(self.authority, self.interventions, self.hyp, self.p)

    def _evaluate(self, wanted: list[str]) -> DataFrame:
        return E.evaluate_models(self.sizes, self.changes, self.predictions, self.hyp, self.p, self.run_id, wanted)

    def evaluation(self) -> DataFrame:
        """Main model of every hypothesis and the descriptive trends."""
        return self._evaluate(C.MODELS[:1]).unionByName(E.trend_rows(self.trend, self.p, self.run_id))

    def ablation(self) -> DataFrame:
        """Every model of the inferential hypotheses."""
        return self._evaluate(C.MODELS)

    def placebo(self) -> DataFrame:
        """Main model on windows anchored before the real change."""
        sizes = materialize(E.sample_sizes(self.stored_placebo_windows, self.placebo_predictions, self.hyp), "placebo_sizes")
        table = E.evaluate_models(sizes, self.placebo_changes, self.placebo_predictions, self.hyp, self.p, self.run_id,
                                  C.MODELS[:1], "placebo")
        zero = (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)
        return table.withColumn("contains_zero", F.coalesce(zero, F.lit(False)))

    def series(self) -> DataFrame:
        return event_series(self.stored_windows, self.view, self.curve, self.hyp, self.p)

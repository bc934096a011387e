"""Weekly event-time series of treated and control pages, indexed to their own baseline."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftlens import constants as C
from liftlens.functions.binding import constant_map
from liftlens.operators.windows import with_expected_ctr
from liftlens.params import Params, arms


def week_bounds(p: Params) -> tuple[int, int, int]:
    """First week, exclusive last week and last baseline week relative to the change."""
    return (math.floor(-(p.buffer_days + p.pre_days) / 7), math.ceil((p.ramp_days + p.post_days) / 7),
            math.floor((-p.buffer_days - 1) / 7))


def event_series(windows: DataFrame, view: DataFrame, curve: DataFrame, hyp: DataFrame, p: Params) -> DataFrame:
    """Mean index per hypothesis, series and week, on the full week grid.

    The join of page pieces with the panel is by (page, segment) with the date range as residual, and
    the weekly grouping and the baseline window reuse its partitioning. Only one row per piece and
    week goes into the final average, which combines before its shuffle.
    """
    first, end, base_last = week_bounds(p)
    label = constant_map(C.INTERVENTION_LABELS)
    names = arms(hyp).select("hypothesis_id", "arm", F.col("metric").alias("own_metric"),
                             F.concat(F.lit(C.TREATED_SERIES), label[F.col("type")]).alias("arm_name"))
    pieces = (windows.where(F.col("eligible") & ((F.col("role") == "treated") | (F.col("arm") == "a")))
              .where(F.col("period") == "pre")
              .join(F.broadcast(names), ["hypothesis_id", "arm"])
              .where(F.col("metric") == F.col("own_metric"))
              .select("hypothesis_id", "metric", "arm", "window_key", "page", "segment", "role",
                      F.when(F.col("role") == "treated", F.col("arm_name")).otherwise(C.CONTROL_SERIES).alias("name")))
    rows = with_expected_ctr(view.withColumn("known_position", F.coalesce("position", F.lit(1.0))), curve,
                             "known_position")
    in_range = ((F.col("v.date") >= F.date_add("e.window_key", 7 * first))
                & (F.col("v.date") < F.date_add("e.window_key", 7 * end)))
    week = F.floor(F.datediff("v.date", "e.window_key") / 7).cast("int")
    piece = ["page", "segment", "hypothesis_id", "metric", "arm", "window_key", "role", "name"]
    shown = F.col("impressions") > 0
    rate = F.try_divide(F.sum(F.when(shown, F.col("clicks"))),
                        F.sum(F.when(shown, F.col("impressions") * F.col("expected_ctr"))))
    value = (F.when(F.col("metric") == "position", F.avg(F.when(shown, F.col("position"))))
             .when(F.col("metric") == "clicks", F.avg("clicks")).otherwise(rate))
    weekly = (pieces.alias("e").join(rows.alias("v"), (F.col("e.page") == F.col("v.page"))
                                     & (F.col("e.segment") == F.col("v.segment")) & in_range)
              .groupBy(*[F.col(f"e.{c}") for c in piece], week.alias("week"))
              .agg(value.alias("weekly"))
              .where(F.col("weekly").isNotNull()))
    baseline = F.avg(F.when(F.col("week") <= base_last, F.col("weekly"))).over(Window.partitionBy(*piece))
    indexed = (weekly.withColumn("baseline", baseline).where(F.col("baseline") != 0)
               .groupBy("hypothesis_id", "name", "role", "week")
               .agg(F.avg(100 * F.col("weekly") / F.col("baseline")).alias("value")))
    grid = (indexed.select("hypothesis_id", "name", "role").distinct()
            .withColumn("week", F.explode(F.sequence(F.lit(first), F.lit(end - 1)))))
    return (grid.join(indexed, ["hypothesis_id", "name", "role", "week"], "left")
            .withColumn("value", F.round("value", 3)))

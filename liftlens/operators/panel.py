"""Daily search panels: segment level, page level and the segment view a hypothesis reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlens import constants as C
from liftlens.params import Params


def _weighted_position() -> F.Column:
    weight = F.sum(F.coalesce(F.col("position"), F.lit(0.0)) * F.col("impressions"))
    return F.when(F.sum("impressions") > 0, F.try_divide(weight, F.sum("impressions")))


def segment_day(gsc: DataFrame) -> DataFrame:
    """Typed segment-level panel; a position that is not a number becomes null."""
    return gsc.select(
        F.col("date").cast("date").alias("date"), "page", "segment",
        F.col("clicks").cast("bigint").alias("clicks"),
        F.col("impressions").cast("bigint").alias("impressions"),
        F.col("position").try_cast("double").alias("position"))


def page_day(segments: DataFrame) -> DataFrame:
    """Page-level panel: sums, with the position weighted by impressions."""
    return segments.groupBy("date", "page").agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
        _weighted_position().alias("position"))


def final_only(panel: DataFrame, p: Params) -> DataFrame:
    """Rows whose values are final at the analysis cutoff; the date filter reaches the scan."""
    return panel.where(F.col("date") <= F.lit(p.available_until))


def segment_view(segments: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The panel of each wanted segment in long form, ``all`` being the page-level panel.

    Each row goes to its own segment and to ``all`` where those are wanted, so one shuffle on
    (page, segment) serves the roll-up here and every later join and grouping by page and segment.
    The input is unique by date, page and segment: a page holds a few rows per day, never a hot key.
    """
    wanted = list(wanted)
    own = [s for s in wanted if s != C.ALL_SEGMENTS]
    targets = F.array(F.col("segment"), F.lit(C.ALL_SEGMENTS)) if C.ALL_SEGMENTS in wanted else F.array("segment")
    rows = segments if C.ALL_SEGMENTS in wanted else segments.where(F.col("segment").isin(own))
    return (rows
            .withColumn("segment", F.explode(F.filter(targets, lambda s: s.isin(wanted))))
            .repartition("page", "segment")
            .groupBy("page", "segment", "date")
            .agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
                 F.when(F.col("segment") == C.ALL_SEGMENTS, _weighted_position())
                 .otherwise(F.max("position")).alias("position")))


def query_segment_day(query_rows: DataFrame, local_pattern: str) -> DataFrame:
    """Query-level rows to the segment panel by a fixed term rule on the query text."""
    segment = F.when(F.col("query").rlike(local_pattern), "local").otherwise("general")
    return (query_rows.withColumn("segment", segment)
            .groupBy("date", "page", "segment")
            .agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
                 _weighted_position().alias("position")))


def data_period(panel: DataFrame) -> DataFrame:
    return panel.agg(F.min("date").alias("start"), F.max("date").alias("end"))

"""The page-level daily panel kept up to date from a stream of segment rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlens.operators.panel import page_day
from liftlens.params import Params


def final_page_day(segment_rows: DataFrame, p: Params) -> DataFrame:
    """Page-level days as they become final.

    The watermark is the finality lag of the study: in append mode a day is emitted once, when rows
    ``gsc_lag_days`` newer have arrived, and later rows of that day no longer enter. The state holds
    one running sum per page and open day.
    """
    timed = (segment_rows.withColumn("date", F.col("date").cast("timestamp"))
             .withWatermark("date", f"{p.gsc_lag_days} days"))
    return page_day(timed).withColumn("date", F.col("date").cast("date"))

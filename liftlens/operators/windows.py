"""Expected click rates, page-window values, eligibility and pre/post changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftlens import constants as C
from liftlens.functions.stats import ctr_bin
from liftlens.params import Params

PAGE_WINDOW_COLUMNS = ["hypothesis_id", "arm", "window_key", "page", "role", "period", "metric",
                       "n_days", "value", "eligible"]


def fit_ctr_curve(page_panel: DataFrame, train_end: DataFrame, p: Params) -> DataFrame:
    """Click rate per position bin from days before the first change: always one row per bin.

    ``train_end`` has one row and is read as a scalar subquery. Gaps take the nearest lower bin,
    then the nearest higher one, then the overall rate. Only the per-bin sums reach the final
    13-row window.
    """
    shown = page_panel.where(
        (F.col("date") < train_end.select("train_end").scalar())
        & (F.col("date") <= F.lit(p.available_until)) & (F.col("impressions") > 0))
    sums = (shown.groupBy(ctr_bin(F.col("position")).alias("bin"))
            .agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
                 F.count("*").alias("training_rows")))
    edges = F.array(*[F.lit(float(e)) for e in C.CTR_EDGES])
    spark = page_panel.sparkSession
    bins = spark.range(1).select(F.posexplode(edges).alias("bin", "edge"))
    whole = Window.partitionBy(F.lit(1)).orderBy("bin").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    before = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = whole.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    dense = bins.join(F.broadcast(sums), "bin", "left").fillna(0, ["clicks", "impressions", "training_rows"])
    rate = dense.withColumn("own", F.when(F.col("impressions") > 0,
                                          F.try_divide(F.col("clicks").cast("double"), F.col("impressions"))))
    overall = F.coalesce(F.try_divide(F.sum("clicks").over(whole).cast("double"),
                                      F.sum("impressions").over(whole)), F.lit(0.0))
    filled = F.coalesce(F.last("own", ignorenulls=True).over(before),
                        F.first("own", ignorenulls=True).over(after), overall)
    return rate.select("bin", "edge", "clicks", "impressions", F.round(filled, 12).alias("ctr"),
                       F.sum("training_rows").over(whole).alias("training_rows"))


def with_expected_ctr(panel: DataFrame, curve: DataFrame, position: str = "position") -> DataFrame:
    """Look up the expected click rate of each row's position; the curve has 13 rows."""
    lookup = F.broadcast(curve.select("bin", F.col("ctr").alias("expected_ctr")))
    return (panel.withColumn("bin", ctr_bin(F.col(position))).join(lookup, "bin", "left").drop("bin"))


def window_sums(design: DataFrame, view: DataFrame, curve: DataFrame) -> DataFrame:
    """Aggregate the panel rows of every page window; a window without rows keeps its row.

    The join is an equi join on (page, segment) with the date range as residual condition, and the
    grouping keys contain both, so the shuffle of the join also serves the grouping.
    """
    shown = F.col("impressions") > 0
    rows = with_expected_ctr(view, curve)
    matched = ((F.col("d.page") == F.col("v.page")) & (F.col("d.segment") == F.col("v.segment"))
               & (F.col("v.date") >= F.col("d.start")) & (F.col("v.date") < F.col("d.end"))
               & (F.col("v.date") <= F.col("d.label_cutoff")))
    keys = ["hypothesis_id", "arm", "window_key", "page", "role", "period", "segment"]
    carried = ["start", "end", "metric", "window_eligible"]
    return (design.alias("d").join(rows.alias("v"), matched, "left")
            .groupBy(*[F.col(f"d.{c}") for c in keys + carried])
            .agg(F.count("v.date").alias("rows"),
                 F.count_if(shown).alias("shown_days"),
                 F.sum("clicks").alias("clicks"),
                 F.sum(F.when(shown, F.col("clicks"))).alias("shown_clicks"),
                 F.sum(F.when(shown, F.col("impressions"))).alias("shown_impressions"),
                 F.sum(F.when(shown, F.col("position") * F.col("impressions"))).alias("position_weight"),
                 F.sum(F.when(shown, F.col("impressions") * F.col("expected_ctr"))).alias("expected_clicks")))


def window_values(sums: DataFrame) -> DataFrame:
    """Log-scale value and shown days of each window: the metric of the hypothesis, and the raw
    click rate next to the adjusted one."""
    days = F.datediff("end", "start")
    counted = (F.col("rows") > 0) & (days > 0)
    some = F.col("shown_days") > 0
    half = F.lit(0.5)
    values = {
        "position": F.when(some, F.ln(F.try_divide(F.col("position_weight"), F.col("shown_impressions")))),
        "clicks": F.when(counted, F.ln(F.try_divide(F.col("clicks") + half, days))),
        "ctr_adjusted": F.when(some, F.ln((F.col("shown_clicks") + half) / (F.col("expected_clicks") + half))),
        "ctr_raw": F.when(some, F.ln((F.col("shown_clicks") + half) / (F.col("shown_impressions") + half))),
    }
    main = F.when(F.col("metric") == "position", values["position"])
    for name in ("clicks", "ctr_adjusted"):
        main = main.when(F.col("metric") == name, values[name])
    main_days = F.when((F.col("metric") == "clicks") & ~counted, F.lit(0)).otherwise(F.col("shown_days")).cast("int")
    return sums.select("*", main_days.alias("n_days"), main.alias("value"), values["ctr_raw"].alias("raw_value"))


def page_windows(design: DataFrame, view: DataFrame, curve: DataFrame, p: Params) -> DataFrame:
    """Value and eligibility of every page window, one row per metric.

    Eligibility follows the main metric. A treated page needs enough days in both of its periods; a
    control page needs them in every eligible window of the hypothesis. Both windows partition by
    page and segment among others (a hypothesis has one segment), so they reuse the join's shuffle.
    """
    page_key = Window.partitionBy("page", "segment", "hypothesis_id")
    window_key = Window.partitionBy("page", "segment", "hypothesis_id", "arm", "window_key", "role")
    values = window_values(window_sums(design, view, curve))
    judged = (values
              .withColumn("min_days", F.min("n_days").over(window_key))
              .withColumn("ok", (F.col("min_days") >= p.min_days_per_window) & F.col("window_eligible"))
              .withColumn("controls_ok", F.bool_and(F.when((F.col("role") == "control") & F.col("window_eligible"),
                                                           F.col("ok"))).over(page_key)))
    eligible = F.when(F.col("role") == "treated", F.col("ok")).otherwise(
        F.col("window_eligible") & F.coalesce(F.col("controls_ok"), F.lit(False)))
    main = F.struct(F.col("metric"), F.col("n_days"), F.col("value"))
    raw = F.struct(F.lit("ctr_raw").alias("metric"), F.col("shown_days").cast("int").alias("n_days"),
                   F.col("raw_value").alias("value"))
    metrics = F.when(F.col("metric") == "ctr_adjusted", F.array(main, raw)).otherwise(F.array(main))
    return (judged.select("hypothesis_id", "arm", "window_key", "page", "role", "period", "segment",
                          eligible.alias("eligible"), metrics.alias("metrics"))
            .select("*", F.inline("metrics"))
            .select(*PAGE_WINDOW_COLUMNS, "segment"))


def pre_post(windows: DataFrame) -> DataFrame:
    """Pre and post value and their difference for eligible page windows that have both."""
    def of(period):
        return F.max(F.when(F.col("period") == period, F.col("value"))).alias(period)

    return (windows.where("eligible")
            .groupBy("hypothesis_id", "metric", "arm", "window_key", "page", "segment", "role")
            .agg(of("pre"), of("post"))
            .where(F.col("pre").isNotNull() & F.col("post").isNotNull())
            .withColumn("delta", F.col("post") - F.col("pre")))

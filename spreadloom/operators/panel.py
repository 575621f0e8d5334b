"""Bars: the last price of each leg and bar, and the same carried forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.fixtures import HOUR, bar_of

LEG = ["event_id", "ladder_order", "ladder_label"]


def bars_last(points: DataFrame, *, minutes: int = HOUR) -> DataFrame:
    """The last price of each bar by (ts, seq); bars without a price have no row. Combined before the shuffle."""
    held = points.where(F.col("p").isNotNull()).withColumn("bar", bar_of(F.col("ts"), minutes))
    return held.groupBy(*LEG, "bar").agg(F.max_by("p", F.struct("ts", "seq")).alias("p"))


def bars_ffill(bars: DataFrame) -> DataFrame:
    """Every bar between a leg's first and last one, empty ones with the price before."""
    grid = bars.groupBy(*LEG).agg(F.min("bar").alias("lo"), F.max("bar").alias("hi")).select(*LEG, F.explode(F.sequence("lo", "hi")).alias("bar"))
    leg = Window.partitionBy(*LEG).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(bars, [*LEG, "bar"], "left").select(*LEG, "bar", F.last("p", ignorenulls=True).over(leg).alias("p"))


def tau_days(bars: DataFrame, legs: DataFrame, *, minutes: int = HOUR) -> DataFrame:
    """``bars`` with the days left to their leg's deadline, at least 1."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("bar") * minutes / 1440).cast("int"))
    return bars.join(legs.select(*LEG, "deadline_date"), LEG).withColumn("tau_days", F.greatest(F.datediff("deadline_date", day), F.lit(1))).drop("deadline_date")


def panel_build(points: DataFrame, legs: DataFrame, *, minutes: int = HOUR) -> DataFrame:
    """Bars with their leg's deadline and the days left to it, at least 1."""
    return tau_days(bars_last(points, minutes=minutes), legs, minutes=minutes).select(*LEG, "bar", "p", "tau_days")


def distinct_dates_having(legs: DataFrame, k: int) -> DataFrame:
    """Events with at least ``k`` distinct deadlines."""
    return legs.groupBy("event_id").agg(F.count_distinct("deadline_date").alias("n_dates")).where(F.col("n_dates") >= k)

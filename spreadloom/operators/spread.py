"""Spreads of all leg pairs and their rolling statistics, none of which looks ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["event_id", "short_dd", "long_dd"]


def spread_panel(panel: DataFrame) -> DataFrame:
    """Each pair of an event's legs, short before long by (order, label), at each bar that both have.

    Where the panel has a ``ladder_type``, legs pair within their type only, and pairs tell it and their ``gap``, the
    distance of the legs' orders (days, or a threshold's units). One shuffle of the panel by event (and type) and bar
    serves both sides of the self-join.
    """
    tau, kind = "tau_days" in panel.columns, ["ladder_type"] if "ladder_type" in panel.columns else []
    cols = lambda side: [F.col("ladder_order").alias(f"o_{side}"), F.col("ladder_label").alias(f"{side}_dd"), F.col("p").alias(f"p_{side}"), *([F.col("tau_days").alias(f"tau_{side}")] if tau else [])]
    short = panel.select("event_id", *kind, "bar", *cols("short"))
    long = panel.select("event_id", *kind, "bar", *cols("long"))
    pairs = short.join(long, ["event_id", *kind, "bar"]).where(F.struct("o_short", "short_dd") < F.struct("o_long", "long_dd"))
    gap = [F.abs(F.col("o_long") - F.col("o_short")).cast("double").alias("gap")] if kind else []
    return pairs.select(*PAIR, *kind, "bar", "p_short", "p_long", (F.col("p_long") - F.col("p_short")).alias("spread"), *(["tau_short", "tau_long"] if tau else []), *gap)


def _z(x, mu, sigma):
    return (x - mu) / F.nullif(sigma, F.lit(0.0))


def rolling_z(spreads: DataFrame, *, window: int = 48, min_obs: int = 20, value: str = "spread") -> DataFrame:
    """mu, sigma and z of ``value`` against the ``window`` rows before its own."""
    w = Window.partitionBy(*PAIR).orderBy("bar").rowsBetween(-window, -1)
    enough = F.count(value).over(w) >= min_obs
    mu, sigma = F.when(enough, F.avg(value).over(w)), F.when(enough, F.stddev_samp(value).over(w))
    held = spreads.withColumns({"mu": mu, "sigma": sigma})
    return held.withColumn("z", _z(F.col(value), F.col("mu"), F.col("sigma")))


def diff_rolling_z(spreads: DataFrame, *, h: int = 6, window: int = 48, min_obs: int = 16) -> DataFrame:
    """The same for the change over ``h`` rows, dS."""
    w = Window.partitionBy(*PAIR).orderBy("bar")
    return rolling_z(spreads.withColumn("dS", F.col("spread") - F.lag("spread", h).over(w)), window=window, min_obs=min_obs, value="dS")


def latest_spread(spreads: DataFrame) -> DataFrame:
    return spreads.groupBy(*PAIR).agg(F.max_by("spread", "bar").alias("spread"), F.max("bar").alias("bar"))


def pair_intersection(filled: DataFrame, *, least: int = 120) -> DataFrame:
    """Pairs of forward-filled legs with at least ``least`` common bars, and their span."""
    pairs = spread_panel(filled)
    return pairs.groupBy(*PAIR).agg(F.count("*").alias("n"), F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar")).where(F.col("n") >= least)

"""Signals from rolling statistics, and the filters in front of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spread import PAIR


def signals_rolling(stats: DataFrame, *, z_enter: float = 1.75, d_min: float = 0.05, s_min: float = -1.0, s_max: float = 1.0, tau_min: int = 0) -> DataFrame:
    """BUY where the spread lies ``z_enter`` deviations and ``d_min`` below its mean, SELL where above. One pass."""
    buy = (F.col("z") <= -z_enter) & (F.col("mu") - F.col("spread") >= d_min) & (F.col("spread") >= s_min)
    sell = (F.col("z") >= z_enter) & (F.col("spread") - F.col("mu") >= d_min) & (F.col("spread") <= s_max)
    held = stats.where(F.col("sigma") > 1e-6)
    held = held.where(F.col("tau_short") >= tau_min) if "tau_short" in stats.columns else held
    return held.withColumn("direction", F.when(buy, "BUY").when(sell, "SELL")).where("direction is not null")


def signals_diff(stats: DataFrame, *, z_enter: float = 2.0, z_max: float = 6.0, sigma_floor: float = 0.002, frac: float = 0.5, tau_min: int = 0) -> DataFrame:
    """Fade changes of ``z_enter`` to ``z_max`` deviations; the target mean gives back ``frac`` of the change. Where the
    panel knows the short leg's days to its deadline, it must have ``tau_min``."""
    held = stats.where((F.col("sigma") >= sigma_floor) & (F.abs("z") >= z_enter) & (F.abs("z") <= z_max) & (F.col("spread") >= 0))
    held = held.where(F.col("tau_short") >= tau_min) if "tau_short" in stats.columns else held
    return held.withColumn("direction", F.when(F.col("z") > 0, "SELL").otherwise("BUY")).withColumn("mu", F.col("spread") - F.lit(frac) * F.col("dS"))


def signals_latest(signals: DataFrame, panel: DataFrame) -> DataFrame:
    """Signals of the panel's last bar only."""
    return signals.where(F.col("bar") == panel.agg(F.max("bar").alias("bar")).scalar())


def signal_legs(signals: DataFrame) -> DataFrame:
    """The distinct legs that signals touch."""
    short = signals.select("event_id", F.col("short_dd").alias("ladder_label"))
    return short.unionByName(signals.select("event_id", F.col("long_dd").alias("ladder_label"))).distinct()


def triggered(signals: DataFrame, *, hs: list[int], z: float, cap: float) -> DataFrame:
    """Signals of the given horizons, over the threshold, on legs no wider than ``cap`` (max_leg)."""
    return signals.where(F.col("h").isin(hs) & (F.abs("z") >= z) & (F.col("max_leg") <= cap))


def signal_pairs(signals: DataFrame) -> DataFrame:
    return signals.select(*PAIR).distinct()


def legs_with_tokens(signals: DataFrame, legs: DataFrame) -> DataFrame:
    """The distinct legs that signals touch with their market's tokens; legs that the universe lacks go."""
    return signal_legs(signals).join(legs.select("event_id", "ladder_label", "yes_token", "no_token"), ["event_id", "ladder_label"])


def fees_attach(legs: DataFrame, fees: DataFrame) -> DataFrame:
    """``legs`` with the fee_rate and fee_exp of their yes_token in a table of fees (token, fee_rate, fee_exp); legs
    without an entry, or with a part of it missing, pay none."""
    rows = fees.groupBy(F.col("token").alias("yes_token")).agg(F.min(F.struct("fee_rate", "fee_exp")).alias("fee"))
    held = legs.drop("fee_rate", "fee_exp").join(rows, "yes_token", "left")
    return held.withColumns({c: F.coalesce(F.col(f"fee.{c}"), F.lit(0.0)) for c in ("fee_rate", "fee_exp")}).drop("fee")


def _leg(legs: DataFrame, side: str, *columns: str) -> DataFrame:
    return legs.select("event_id", F.col("ladder_label").alias(f"{side}_dd"), *[F.col(c).alias(f"{c}_{side}") for c in columns])


def with_legs(rows: DataFrame, legs: DataFrame, *columns: str) -> DataFrame:
    """Both legs' ``columns`` beside each row, missing legs as null. Spark broadcasts the dimension while it is small."""
    return rows.join(_leg(legs, "short", *columns), ["event_id", "short_dd"], "left").join(_leg(legs, "long", *columns), ["event_id", "long_dd"], "left")


def capacity_filter(signals: DataFrame, legs: DataFrame, *, ratio: float = 2.0, cap: float = 0.1, liquidity: float = 0.0) -> DataFrame:
    """Signals whose edge is ``ratio`` times their cost, on legs that are tight and liquid enough; a missing leg fails."""
    held = with_legs(signals, legs, "market_spread", "liquidity")
    cost = F.col("market_spread_short") + F.col("market_spread_long")
    held = held.withColumns({"cost": cost, "edge": F.abs(F.col("mu") - F.col("spread"))})
    passes = (F.col("edge") >= ratio * F.col("cost")) & (F.greatest("market_spread_short", "market_spread_long") <= cap) & (F.least("liquidity_short", "liquidity_long") >= liquidity)
    both = F.col("market_spread_short").isNotNull() & F.col("market_spread_long").isNotNull()
    return held.where(both & passes).select(signals.columns + ["cost", "edge"])


def leg_fee(p, rate, exponent):
    """rate * (p (1 - p)) ^ exponent a share, 0 without a positive rate."""
    return F.when(rate > 0, rate * F.pow(p * (1 - p), exponent)).otherwise(F.lit(0.0))


def cost_attach(signals: DataFrame, legs: DataFrame, *, multiple: float = 1.0) -> DataFrame:
    """Round-trip cost: spreads of both legs, and twice their fees at the signal's prices; signals with a missing leg go."""
    held = with_legs(signals, legs, "market_spread", "fee_rate", "fee_exp")
    fees = leg_fee(F.col("p_short"), F.col("fee_rate_short"), F.col("fee_exp_short")) + leg_fee(F.col("p_long"), F.col("fee_rate_long"), F.col("fee_exp_long"))
    cost = multiple * (F.col("market_spread_short") + F.col("market_spread_long")) + 2 * fees
    return held.withColumns({"cost": cost, "max_leg": F.greatest("market_spread_short", "market_spread_long")}).where("cost is not null").select(signals.columns + ["cost", "max_leg"])


def leg_cost_default(rows: DataFrame, legs: DataFrame, *, cap: float = 0.1) -> DataFrame:
    """Cost of both legs, twice the cap for a missing one."""
    held = with_legs(rows, legs, "market_spread")
    return held.withColumn("cost", F.coalesce("market_spread_short", F.lit(2 * cap)) + F.coalesce("market_spread_long", F.lit(2 * cap))).select(rows.columns + ["cost"])


def universe_filter(legs: DataFrame, *, exclude: list[str], volume: float, cap: float, least_legs: int = 2) -> DataFrame:
    """Legs without an excluded tag, above the volume floor and below the spread cap (missing values pass), of events
    that keep ``least_legs`` distinct legs."""
    tags = F.split("tags", ",")
    held = legs.where(~F.arrays_overlap(tags, F.array(*map(F.lit, exclude)))).where((F.coalesce("liquidity", F.lit(volume)) >= volume) & (F.coalesce("market_spread", F.lit(0.0)) <= cap))
    counts = held.groupBy("event_id").agg(F.count_distinct("ladder_label").alias("n_legs")).where(F.col("n_legs") >= least_legs)
    return held.join(counts.select("event_id"), "event_id", "left_semi")


def cooldown_filter(plans: DataFrame, recent: DataFrame, *, keys: list[str] = PAIR, span: int) -> DataFrame:
    """Plans (keys, bar, ...) whose key has no recent entry (keys, bar) within the ``span`` bars up to the plan's; at
    exactly ``span`` bars a plan may go. One sorted pass over plans and entries of a key finds the last entry."""
    row = F.struct(*[c for c in plans.columns if c not in keys])
    asks = plans.select(*keys, "bar", F.lit(1).alias("side"), row.alias("plan"))
    tells = recent.select(*keys, "bar", F.lit(0).alias("side"), F.lit(None).cast(asks.schema["plan"].dataType).alias("plan"))
    along = Window.partitionBy(*keys).orderBy("bar", "side").rowsBetween(Window.unboundedPreceding, 0)
    held = asks.unionByName(tells).withColumn("last", F.last(F.when(F.col("side") == 0, F.col("bar")), ignorenulls=True).over(along)).where("side = 1")
    return held.where(F.col("last").isNull() | (F.col("bar") - F.col("last") >= span)).select(*keys, "plan.*").select(plans.columns)

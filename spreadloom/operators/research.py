"""Research over differenced spreads: signal grids, non-overlapping reversion, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .quantiles import exact_percentiles
from .signals import leg_fee, with_legs
from .spread import PAIR
from .trades import greedy, tstat


def time_grid(spreads: DataFrame, *, least: int = 60) -> DataFrame:
    """Every bar between a pair's first and last one, with no spread where there is none, of pairs with ``least`` bars."""
    span = spreads.groupBy(*PAIR).agg(F.min("bar").alias("lo"), F.max("bar").alias("hi"), F.count("*").alias("n")).where(F.col("n") >= least)
    grid = span.select(*PAIR, F.explode(F.sequence("lo", "hi")).alias("bar"))
    return grid.join(spreads.select(*PAIR, "bar", "spread"), [*PAIR, "bar"], "left")


def diffz_signals(spreads: DataFrame, *, hs: list[int], windows: list[int], z_floor: float, least: int = 10) -> DataFrame:
    """Candidates of every (h, W): z of the change over h rows against the W changes before, whose deviation is sd, and
    the traded return from the next row, whose spread is s_in, over h rows. Rows are bars: take a forward-filled panel
    or a ``time_grid``. All windows share the pair's one sorted partition; grid points become rows at the end."""
    pair = Window.partitionBy(*PAIR).orderBy("bar")
    s_in = {"s_in": F.lead("spread", 1).over(pair)}
    held = spreads.withColumns(s_in | {f"ds_{h}": F.col("spread") - F.lag("spread", h).over(pair) for h in hs} | {f"fwd_{h}": F.lead("spread", h + 1).over(pair) - F.lead("spread", 1).over(pair) for h in hs})
    points, grid = {}, []
    for h in hs:
        for w in windows:
            before, ds = pair.rowsBetween(-w, -1), f"ds_{h}"
            enough = F.count(ds).over(before) >= max(least, w // 3)
            sd = F.stddev_samp(ds).over(before)
            points[f"sd_{h}_{w}"] = sd
            points[f"z_{h}_{w}"] = F.when(enough & (sd > 1e-9), (F.col(ds) - F.avg(ds).over(before)) / F.nullif(sd, F.lit(0.0)))
            grid.append(F.struct(F.lit(h).alias("h"), F.lit(w).alias("w"), F.col(f"z_{h}_{w}").alias("z"), F.col(f"sd_{h}_{w}").alias("sd"), F.col(ds).alias("dS"), F.col(f"fwd_{h}").alias("fwd")))
    out = held.withColumns(points).select(*PAIR, "bar", F.col("spread").alias("S"), "s_in", F.explode(F.array(*grid)).alias("g"))
    return out.select(*PAIR, "bar", "S", "s_in", "g.*").where(F.col("z").isNotNull() & F.col("fwd").isNotNull() & (F.abs("z") >= z_floor))


def reversion(signals: DataFrame) -> DataFrame:
    """gross: what fading the change earns."""
    return signals.withColumn("gross", -F.signum("z") * F.col("fwd"))


def level_cost(signals: DataFrame, legs: DataFrame, *, multiple: float = 1.0) -> DataFrame:
    """cost (spreads of both legs, and twice the fees at the spread's level) and max_leg; signals with a missing leg go."""
    held = with_legs(signals, legs, "market_spread", "fee_rate", "fee_exp")
    fee = lambda p, leg: F.when((p > 0) & (p < 1), leg_fee(p, F.col(f"fee_rate_{leg}"), F.col(f"fee_exp_{leg}"))).otherwise(F.lit(0.0))
    fees = fee(F.col("S"), "long") + fee(1 - F.col("S"), "short")
    cost = multiple * (F.col("market_spread_short") + F.col("market_spread_long")) + 2 * fees
    return held.withColumns({"cost": cost, "max_leg": F.greatest("market_spread_short", "market_spread_long")}).where("cost is not null").select(signals.columns + ["cost", "max_leg"])


def nonoverlap_pair(signals: DataFrame, *, z: float, by: list[str] | None = None) -> DataFrame:
    """Earliest first, the next of a pair's (h, W) no earlier than the hold of h bars and the entry bar allow."""
    return greedy(signals.where(F.abs("z") >= z), [*PAIR, "h", "w", *(by or [])], start="bar", free=F.col("bar") + F.col("h") + 1)


def nonoverlap_event(signals: DataFrame, *, z: float) -> DataFrame:
    """One a window of the event; of equal bars the larger |z|, to nine digits, then the pair's labels: mirrored pairs
    have equal |z| up to rounding."""
    held = signals.where(F.abs("z") >= z).withColumn("rank", -F.round(F.abs("z"), 9))
    return greedy(held, ["event_id", "h", "w"], start="bar", free=F.col("bar") + F.col("h") + 1, order=["rank", "short_dd", "long_dd"]).drop("rank")


def clean_signals(signals: DataFrame, *, z: float, sigma_floor: float, drop_inverted: bool = True) -> DataFrame:
    """Signals over a floor of sigma, without entries at a negative spread, one a window of the event."""
    held = signals.where(F.col("sd") >= sigma_floor)
    return nonoverlap_event(held.where("s_in >= 0") if drop_inverted else held, z=z)


def signal_funnel(signals: DataFrame, *, z: float, sigma_floor: float) -> DataFrame:
    """Per (h, W): candidates, those over the threshold, and what the floor of sigma and the entry's sign then drop."""
    over, low = F.abs("z") >= z, F.col("sd") < sigma_floor
    return signals.groupBy("h", "w").agg(
        F.count("*").alias("n"), F.count_if(over).alias("n_z"), F.count_if(over & low).alias("dropped_sigma"), F.count_if(over & ~low & (F.col("s_in") < 0)).alias("dropped_inverted"), F.count_if(over & ~low & (F.col("s_in") >= 0)).alias("n_clean")
    )


def deep_grid(signals: DataFrame, *, thresholds: list[float], caps: list[float], least: int = 8) -> DataFrame:
    """Per (h, W, z, cap of the wider leg): non-overlapping reversion net of cost in hundredths, hit and t; nulls below
    ``least`` trades. One fold over (pair, h, W, z, cap); candidates come from the same windows."""
    points = F.array(*[F.struct(F.lit(float(t)).alias("z_enter"), F.lit(float(c)).alias("cap")) for t in thresholds for c in caps])
    each = signals.withColumn("g", F.explode(points)).select(*signals.columns, "g.*")
    each = each.where((F.abs("z") >= F.col("z_enter")) & (F.col("max_leg") <= F.col("cap")))
    kept = nonoverlap_pair(each, z=0.0, by=["z_enter", "cap"]).withColumn("net", (-F.signum("z") * F.col("fwd") - F.col("cost")) * 100)
    enough = F.count("*") >= least
    return kept.groupBy("h", "w", "z_enter", "cap").agg(F.count("*").alias("n"), F.when(enough, F.avg("net")).alias("net_c"), F.when(enough, F.avg((F.col("net") > 0).cast("double"))).alias("hit"), tstat(F.col("net"), least).alias("t"))


def diffz_grid(signals: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per (h, W, z): count, mean reversion and hit; where signals have a ``cost``, also reversion and momentum net of it."""
    each = reversion(signals).withColumn("z_enter", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).where(F.abs("z") >= F.col("z_enter"))
    net = [F.avg(F.col("gross") - F.col("cost")).alias("rev_net"), F.avg(-F.col("gross") - F.col("cost")).alias("mom_net"), F.avg((F.col("gross") < -F.col("cost")).cast("double")).alias("mom_hit"), F.avg("cost").alias("mean_cost")] if "cost" in signals.columns else []
    return each.groupBy("h", "w", "z_enter").agg(F.count("*").alias("n"), F.avg("gross").alias("gross"), F.avg((F.col("gross") > 0).cast("double")).alias("hit"), *net)


def top_configs(grid: DataFrame, *, by: str, least: int, n: int = 12) -> DataFrame:
    """The ``n`` grid points with the largest value of ``by`` among those with ``least`` trades."""
    return grid.where((F.col("n") >= least) & F.col(by).isNotNull()).orderBy(F.desc(F.round(by, 9)), *[c for c in ("h", "w", "z_enter", "cap") if c in grid.columns]).limit(n)


def diffz_confirm(signals: DataFrame, *, z: float) -> DataFrame:
    """Mean traded return by the sign of z and of the spread's level."""
    held = signals.where(F.abs("z") >= z)
    return held.groupBy("h", "w").agg(*[F.avg(F.when((F.signum("z") == a) & (F.col("S") >= 0 if b > 0 else F.col("S") < 0), F.col("fwd"))).alias(f"{'up' if a > 0 else 'down'}_{'pos' if b > 0 else 'neg'}") for a in (1, -1) for b in (1, -1)])


def event_study(signals: DataFrame, *, buckets: int = 10, least: int = 50) -> DataFrame:
    """Mean z and traded return by (h, W) and bucket of z, cut at the exact percentiles (to 1e-9) of a grid
    point with ``least`` rows; the cuts come from sketches and counts, no task holds a grid point."""
    signals = written(signals, "event_study")
    cuts = [i / buckets for i in range(1, buckets)]
    at = exact_percentiles(signals, ["h", "w"], "z", cuts).select("h", "w", F.col("percentiles").alias("cuts")).where(F.col("n") >= least)
    bucket = F.size(F.filter("cuts", lambda c: c + 1e-9 < F.col("z")))
    return signals.join(at, ["h", "w"]).groupBy("h", "w", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("z").alias("mean_z"), F.avg("fwd").alias("mean_fwd"))


def signed_symmetry(signals: DataFrame, *, z: float) -> DataFrame:
    up = F.col("z") > 0
    return reversion(signals.where(F.abs("z") >= z)).groupBy("h", "w").agg(F.count_if(up).alias("n_up"), F.count_if(~up).alias("n_down"), tstat(F.when(up, F.col("gross"))).alias("t_up"), tstat(F.when(~up, F.col("gross"))).alias("t_down"))


def event_bootstrap(trades: DataFrame, *, draws: int = 5000, value: str = "pnl") -> DataFrame:
    """Mean, 95 % interval and share of means not above 0 over resampled events.

    Events are reduced to (sum, n) first; a draw's i-th event comes from a hash of (draw, i), the same on every run.
    """
    events = written(trades.groupBy("event_id").agg(F.sum(value).alias("s"), F.count("*").alias("n")), "event_sums")
    ranked = events.withColumn("k", F.row_number().over(Window.orderBy("event_id")) - 1)
    size = events.agg(F.count("*")).scalar()
    picks = events.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), size)))
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.col("draw").cast("string"), F.col("i").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), size)
    means = picks.withColumn("k", pick.cast("int")).join(ranked, "k").groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.avg((F.col("m") <= 0).cast("double")).alias("p_le_0"))


def horizon_autocorr(spreads: DataFrame, *, h: int = 6) -> DataFrame:
    """Correlation of consecutive non-overlapping h-changes, each pair's scaled by its own deviation."""
    pair = Window.partitionBy(*PAIR).orderBy("bar")
    held = spreads.withColumn("rn", F.row_number().over(pair)).where(F.col("rn") % h == 0)
    held = held.withColumn("d", F.col("spread") - F.lag("spread").over(pair)).where("d is not null")
    held = held.withColumn("u", F.col("d") / F.nullif(F.stddev_pop("d").over(Window.partitionBy(*PAIR)), F.lit(0.0)))
    held = held.withColumn("v", F.lag("u").over(pair)).where("u is not null and v is not null")
    return held.agg(F.count("*").alias("n"), F.corr("u", "v").alias("rho"))


def variance_ratio(spreads: DataFrame, *, q: int = 6) -> DataFrame:
    pair = Window.partitionBy(*PAIR).orderBy("bar")
    held = spreads.select(*PAIR, (F.col("spread") - F.lag("spread").over(pair)).alias("d1"), (F.col("spread") - F.lag("spread", q).over(pair)).alias("dq"))
    return held.groupBy(*PAIR).agg((F.var_pop("dq") / F.nullif(q * F.var_pop("d1"), F.lit(0.0))).alias("vr"))


def variance_ratio_summary(spreads: DataFrame, *, q: int = 6) -> DataFrame:
    """Number of pairs with a ratio, the median and the share under 1 (momentum dies out)."""
    held = written(variance_ratio(spreads, q=q).where("vr is not null"), "variance_ratio")
    middle = exact_percentiles(held, [], "vr", [0.5]).select(F.col("percentiles")[0].alias("median"))
    facts = held.agg(F.count("*").alias("n"), F.avg((F.col("vr") < 1).cast("double")).alias("below_1"))
    return facts.join(middle, F.lit(True), "left")


def half_life(spreads: DataFrame) -> DataFrame:
    """AR(1) coefficient of each pair and the bars in which half of a gap closes."""
    pair = Window.partitionBy(*PAIR).orderBy("bar")
    held = spreads.select(*PAIR, "spread", F.lag("spread").over(pair).alias("x")).where("x is not null")
    phi = held.groupBy(*PAIR).agg((F.covar_samp("x", "spread") / F.nullif(F.var_pop("x"), F.lit(0.0))).alias("phi"))
    return phi.withColumn("half_life", F.when((F.col("phi") > 0) & (F.col("phi") < 1), -F.log(F.lit(2.0)) / F.log("phi")))


def half_life_summary(spreads: DataFrame) -> DataFrame:
    held = written(half_life(spreads), "half_life")
    middle = exact_percentiles(held, [], "half_life", [0.5]).select(F.col("percentiles")[0].alias("median"))
    return held.agg(F.count("*").alias("n"), F.count("half_life").alias("n_reverting")).join(middle, F.lit(True), "left")


def tail_reversion(signals: DataFrame, *, z: float = 3.0) -> DataFrame:
    held = reversion(signals.where(F.abs("z") >= z))
    return held.groupBy("h", "w").agg(F.count("*").alias("n"), (F.sum("gross") / F.nullif(F.sum(F.abs("dS")), F.lit(0.0))).alias("share"))


def stale_fraction(spreads: DataFrame, *, h: int = 6) -> DataFrame:
    d = F.col("spread") - F.lag("spread", h).over(Window.partitionBy(*PAIR).orderBy("bar"))
    return spreads.select("event_id", d.alias("d")).where("d is not null").groupBy("event_id").agg(F.avg((F.col("d") == 0).cast("double")).alias("stale"))


def median_bar(bars: DataFrame) -> DataFrame:
    """Median gap between the distinct bars of an event."""
    held = bars.select("event_id", "bar").distinct()
    gap = F.col("bar") - F.lag("bar").over(Window.partitionBy("event_id").orderBy("bar"))
    return held.select("event_id", gap.cast("double").alias("gap")).where("gap is not null").groupBy("event_id").agg(F.percentile("gap", F.lit(0.5)).alias("median_gap"))


def flow_reversion_trades(spreads: DataFrame, *, h: int, window: int, least: int, z: float) -> DataFrame:
    """Non-overlapping reversion on forward-filled legs, of pairs long enough to have a window, a change and a return."""
    enough = spreads.groupBy(*PAIR).agg(F.count("*").alias("m")).where(F.col("m") >= least + h + 2)
    held = diffz_signals(spreads.join(enough.drop("m"), PAIR, "left_semi"), hs=[h], windows=[window], z_floor=z, least=least)
    return reversion(nonoverlap_pair(held, z=z))

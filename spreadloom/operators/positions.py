"""Positions, their ledger, risk and reconciliation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trades import greedy

KEY = ["event_id", "direction"]


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def wcl_per_share(direction: Column, spread: Column) -> Column:
    """Worst loss of a share: the spread when it was bought, the rest of 1 when it was sold."""
    return F.when(direction == "BUY", clamp(spread)).otherwise(1 - clamp(spread))


def accumulate_positions(clips: DataFrame) -> DataFrame:
    """One position a key: shares, cost, share-weighted entry spread, first day, number of clips. Combined map-side."""
    weighted = F.sum(F.col("shares") * F.col("spread")) / F.nullif(F.sum("shares"), F.lit(0.0))
    return clips.groupBy(*KEY).agg(F.sum("shares").alias("shares"), weighted.alias("entry_spread"), F.min("day").alias("first_day"), F.count("*").alias("n_adds"))


def open_wcl(positions: DataFrame, *by: str) -> DataFrame:
    return positions.groupBy(*by).agg(F.sum(F.col("shares") * wcl_per_share(F.col("direction"), F.col("entry_spread"))).alias("wcl"))


def payoff_risk(positions: DataFrame) -> DataFrame:
    """Largest loss and gain of a share and their ratio."""
    loss = wcl_per_share(F.col("direction"), F.col("entry_spread"))
    return positions.withColumns({"max_loss": loss, "max_gain": 1 - loss}).withColumn("reward_risk", F.col("max_gain") / F.nullif(F.col("max_loss"), F.lit(0.0)))


def recommended_size(plans: DataFrame, *, bankroll: float = 10_000.0, frac: float = 0.05, cap: float = 400.0, z_full: float = 3.0, least: int = 10, most: int = 500) -> DataFrame:
    """Shares by conviction: half the budget at z 0, all of it at ``z_full``, divided by the cost of a share."""
    budget = F.least(F.lit(bankroll * frac), F.lit(cap)) * (0.5 + 0.5 * F.least(F.lit(1.0), F.abs("z") / z_full))
    shares = F.floor(budget / F.nullif(F.col("unit_cost"), F.lit(0.0)))
    return plans.withColumn("shares", F.least(F.greatest(shares, F.lit(least)), F.lit(most)).cast("long"))


def held_filter(plans: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    return plans.join(positions.select(*keys), keys, "left_anti")


def exits_due(positions: DataFrame, *, day: int, hold: int) -> DataFrame:
    return positions.where(F.lit(day) - F.col("first_day") >= hold)


def realized_pnl(closed: DataFrame) -> DataFrame:
    """Proceeds less entry cost of closed positions."""
    return closed.withColumn("pnl", F.col("proceeds") - F.col("cost")).groupBy("direction").agg(F.count("*").alias("n"), F.sum("pnl").alias("total"), F.avg((F.col("pnl") > 0).cast("double")).alias("hit"))


def open_mtm(positions: DataFrame, bids: DataFrame) -> DataFrame:
    """Value of open positions at the best bids of both legs (token_a, token_b); a missing bid gives null."""
    a = bids.select(F.col("token").alias("token_a"), F.col("bid").alias("bid_a"))
    b = bids.select(F.col("token").alias("token_b"), F.col("bid").alias("bid_b"))
    held = positions.join(a, "token_a", "left").join(b, "token_b", "left")
    return held.withColumn("mtm", F.col("shares") * (F.col("bid_a") + F.col("bid_b")) - F.col("cost"))


def ledger_replay(signals: DataFrame, marks: DataFrame, *, keys: list[str], hold: int = 24, cost_c: float = 1.0) -> DataFrame:
    """One open row a key at a time; closed by the first mark at least ``hold`` bars later, then it may open again.

    Within a bar marks come before signals. Each signal looks up the mark that would close it in one sorted pass over
    signals and marks; the rows that open are then picked among the signals alone, each after the last one's close.
    """
    asks = signals.select(*keys, (F.col("bar") + max(hold, 1)).alias("at"), F.lit(0).alias("side"), F.struct("bar", "direction", "spread").alias("signal"), F.lit(None).cast("struct<bar:bigint,spread:double>").alias("mark"))
    tells = marks.select(*keys, F.col("bar").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(asks.schema["signal"].dataType).alias("signal"), F.struct(F.col("bar").cast("long").alias("bar"), F.col("spread").cast("double").alias("spread")).alias("mark"))
    backwards = Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc("side"), F.desc("mark")).rowsBetween(Window.unboundedPreceding, 0)
    held = asks.unionByName(tells).withColumn("mark", F.last("mark", ignorenulls=True).over(backwards)).where("side = 0")
    rows = held.select(*keys, F.col("signal.bar").alias("entry_bar"), F.col("signal.direction").alias("direction"), F.col("signal.spread").alias("entry_spread"), F.col("mark.bar").alias("exit_bar"), F.col("mark.spread").alias("exit_spread"))
    out = greedy(rows, keys, start="entry_bar", free=F.coalesce(F.col("exit_bar").cast("double"), F.lit(float("inf"))), order=["direction", "entry_spread"])
    sign = F.when(F.col("direction") == "BUY", 1.0).otherwise(-1.0)
    pnl = F.round(sign * (F.col("exit_spread") - F.col("entry_spread")) * 100 - cost_c, 4)
    return out.withColumns({"status": F.when(F.col("exit_bar").isNull(), "open").otherwise("closed"), "pnl_c": pnl})


def ledger_summary(ledger: DataFrame) -> DataFrame:
    closed = F.col("status") == "closed"
    pnl = F.when(closed, F.col("pnl_c"))
    return ledger.agg(F.count_if(closed).alias("n"), F.count_if(~closed).alias("n_open"), F.sum(pnl).alias("total"), F.avg(pnl).alias("mean"), F.avg((pnl > 0).cast("double")).alias("hit"))


def _pair_off(owned: pa.Table, balance: float) -> pa.Table:
    """The pairs of one event's held legs (leg, o: whether yes, token, size) that a walk over all pairs takes, ordered by
    short leg, long leg, direction, tokens and sizes."""
    owned = owned.combine_chunks()
    place = lambda c: pc.rank(owned.column(c).combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)
    leg, token, yes, size = place("leg"), place("token"), owned.column("o").to_numpy(), owned.column("size").to_numpy()
    order = np.lexsort((size, token, ~yes, leg))  # that of long legs: BUY, a long yes, comes first
    leg, token, yes, size = leg[order], token[order], yes[order], size[order]
    used = np.zeros(len(order) + 1, bool)
    ends = np.searchsorted(leg, leg, "right")

    def partner(s: int, at: int) -> int:
        """The first long leg from ``at`` on that short leg ``s`` can have; the number of all, if none."""
        step = 64
        while at < len(leg):
            part = slice(at, at + step)
            fits = (yes[part] != yes[s]) & ~used[token[part]] & (np.minimum(size[part], size[s]) >= balance * np.maximum(size[part], size[s]))
            if fits.any():
                return at + int(fits.argmax())
            at, step = at + step, min(step * 4, 1 << 16)
        return at

    a, b, begin = [], [], 0
    while begin < len(leg):
        end = int(ends[begin])
        nexts = {s: end for s in range(begin, end)}
        while nexts:
            nexts = {s: found for s, at in nexts.items() if not used[token[s]] and (found := partner(s, at)) < len(leg)}
            if nexts:
                s, at = min(nexts.items(), key=lambda x: (leg[x[1]], ~yes[x[1]], token[x[1]], token[x[0]], size[x[1]], size[x[0]]))
                used[token[s]] = used[token[at]] = True
                a.append(order[at])
                b.append(order[s])
        begin = end
    long, short = owned.take(pa.array(a, pa.int64())), owned.take(pa.array(b, pa.int64()))
    direction = pc.if_else(long.column("o"), "BUY", "SELL")
    return pa.table([long.column("event_id"), short.column("leg"), long.column("leg"), direction, long.column("token"), short.column("token"), long.column("size"), short.column("size")], names=["event_id", "short_leg", "long_leg", "direction", "token_a", "token_b", "size_a", "size_b"])


def reconcile_detect(legs: DataFrame, holdings: DataFrame, *, size_min: float = 1.0, balance: float = 0.5) -> DataFrame:
    """Pairs of held legs with opposite outcomes and like sizes; each token in at most one, earlier pairs first.

    An event's held legs are one group, in which the tokens are given out by a walk over short legs: each takes the first
    partner that is left. So a task holds an event's held legs, not their pairs.
    """
    held = holdings.where(F.col("size") >= size_min).select("token", F.col("size").cast("double").alias("size"))
    owned = legs.withColumn("side", F.explode(F.array(F.struct(F.lit(True).alias("o"), F.col("yes").alias("token")), F.struct(F.lit(False).alias("o"), F.col("no").alias("token"))))).select("event_id", "leg", "side.o", "side.token").join(held, "token")
    kinds = dict(legs.dtypes)
    schema = f"event_id {kinds['event_id']}, short_leg {kinds['leg']}, long_leg {kinds['leg']}, direction string, token_a string, token_b string, size_a double, size_b double"
    out = owned.where("event_id is not null and leg is not null").groupBy("event_id").applyInArrow(lambda owned: _pair_off(owned, balance), schema)
    return out.select("event_id", "short_leg", "long_leg", "direction", "token_a", "token_b", F.floor(F.least("size_a", "size_b")).cast("long").alias("shares"))


def adopt(detected: DataFrame, tracked: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are held but not tracked."""
    return detected.select(*keys).join(tracked.select(*keys), keys, "left_anti")


def drop(detected: DataFrame, tracked: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are tracked but not held."""
    return tracked.select(*keys).join(detected.select(*keys), keys, "left_anti")


def reconcile_plan(detected: DataFrame, tracked: DataFrame, keys: list[str]) -> DataFrame:
    """What to adopt and what to drop."""
    return adopt(detected, tracked, keys).withColumn("action", F.lit("adopt")).unionByName(drop(detected, tracked, keys).withColumn("action", F.lit("drop")))

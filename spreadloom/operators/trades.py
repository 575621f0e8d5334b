"""Trades: exits for all signals at once, then one greedy fold per pair over the signals alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .quantiles import weighted_percentiles
from .signals import leg_fee, with_legs
from .spread import PAIR

PRICES = ("p_short", "p_long")


def with_exits(stats: DataFrame, *, max_hold: int = 24, z_exit: float = 0.0) -> DataFrame:
    """Beside each row of statistics: its number rn, the entry row after it, the first row of at most ``max_hold`` after
    the entry that reverts for a BUY and for a SELL, and the horizon, the last row that a trade may reach.

    The frames share the statistics' own sorted partition, so looking ahead takes no join and no shuffle."""
    pair = Window.partitionBy(*PAIR).orderBy("bar")
    held = stats.withColumn("rn", F.row_number().over(pair).cast("long"))
    row = F.struct("rn", "bar", *PRICES)
    ahead = pair.rowsBetween(2, max_hold + 1)
    reverts = lambda yes: F.min(F.when(yes, row)).over(ahead)
    return held.withColumns({
        "entry": F.lead(row, 1).over(pair),
        "back_buy": reverts(F.col("z") >= z_exit),
        "back_sell": reverts(F.col("z") <= -z_exit),
        "horizon": F.last(row).over(pair.rowsBetween(1, max_hold + 1)),
    })


def _exited(signals: DataFrame, max_hold: int) -> DataFrame:
    """Signals with an entry, their exit row and status; those on a pair's last row have none."""
    back = F.when(F.col("direction") == "BUY", F.col("back_buy")).otherwise(F.col("back_sell"))
    full = F.col("horizon.rn") == F.col("entry.rn") + max_hold
    held = signals.where(F.col("entry").isNotNull())
    return held.withColumns({"exit": F.coalesce(back, F.col("horizon")), "status": F.when(back.isNotNull(), "Z").when(full, "T").otherwise("P")})


def trade_exit(signals: DataFrame, *, max_hold: int = 24) -> DataFrame:
    """Each signal's entry and exit row and status, of signals picked from ``with_exits``."""
    return _exited(signals, max_hold).select(*PAIR, F.col("bar").alias("signal_bar"), "direction", F.col("entry.rn").alias("entry_rn"), F.col("exit.rn").alias("exit_rn"), "status")


#: Rows of a key that one array holds. A key of any number of rows is cut into blocks of so many.
BLOCK = 256


def greedy(rows: DataFrame, keys: list[str], *, start: str, free: Column, order: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Earliest first, a row is kept if its ``start`` is not before the ``free`` of the last kept one of its key. Rows
    without a start take no part; a kept row whose ``free`` is null lets the next one follow.

    Rows are numbered by start and then ``order``. A row's successor, the first one it lets follow, comes from a running
    count of starts over starts and frees sorted together. Kept rows are those that successors lead to from a key's
    first one. Blocks of consecutive rows jump: each finds for all its rows where their chain leaves the block. A fold
    over a key's blocks, numbers only, then finds the row by which the chain enters each, and every block follows it
    from there. So no array of rows is longer than a block, and the work grows with the rows, not with their square.
    """
    fields = [c for c in rows.columns if c not in keys]
    first = [start, *(order or []), *[c for c in fields if c not in (start, *(order or []))]]
    key = Window.partitionBy(*keys)
    held = rows.where(F.col(start).isNotNull()).withColumn("__free", free.cast("double"))
    # blocks are read twice; a shuffle that Spark doesn't take for redundant keeps it from making the rows twice
    held = held.repartition(F.xxhash64(*keys))
    held = held.select(*keys, F.struct(*fields).alias("__row"), F.col(start).cast("double").alias("__start"), "__free", F.row_number().over(key.orderBy(*first)).cast("long").alias("__n"))

    # a free (side 0) counts the starts before it, a start itself (side 1) only marks its place
    ends = F.array(F.struct(F.col("__free").alias("at"), F.lit(0).alias("side")), F.struct(F.col("__start").alias("at"), F.lit(1).alias("side")))
    both = held.select(*keys, "__n", "__row", F.explode(ends).alias("__e")).select(*keys, "__n", F.when(F.col("__e.side") == 1, F.col("__row")).alias("__row"), "__e.at", "__e.side")
    run = key.orderBy(F.col("at").asc_nulls_first(), "side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("before", F.sum("side").over(run))
    follows = F.greatest(F.max(F.when(F.col("side") == 0, F.col("before"))), F.col("__n")) + 1
    linked = both.groupBy(*keys, "__n").agg(F.first("__row", ignorenulls=True).alias("row"), follows.alias("next"))

    place = F.floor((F.col("__n") - 1) / block).alias("block")
    blocks = linked.groupBy(*keys, place).agg(F.array_sort(F.collect_list(F.struct(F.col("__n").alias("n"), "next", "row"))).alias("rows"))
    blocks = blocks.withColumn("last", F.col("rows")[F.size("rows") - 1]["n"])
    none = F.array_compact(F.array(F.lit(None).cast("long")))
    leaves = lambda x, later: F.when(x["next"] > F.col("last"), x["next"]).otherwise(F.get(later, (x["next"] - x["n"] - 1).cast("int")))
    links = F.transform(F.reverse("rows"), lambda x: F.struct(x["n"].alias("n"), x["next"].alias("next")))
    exits = F.aggregate(links, none, lambda later, x: F.concat(F.array(leaves(x, later)), later))
    chain = F.array_sort(F.collect_list(F.struct("block", F.col("rows")[0]["n"].alias("first"), "last", exits.alias("exits"))))
    entry = F.lit(None).cast("struct<block:bigint,entry:bigint>")
    state = F.struct(F.lit(1).cast("long").alias("at"), F.array_compact(F.array(entry)).alias("entries"))

    def enter(a: Column, b: Column) -> Column:
        found = F.struct(b["block"].alias("block"), a["at"].alias("entry"))
        moved = F.struct(F.get(b["exits"], (a["at"] - b["first"]).cast("int")).alias("at"), F.concat(a["entries"], F.array(found)).alias("entries"))
        return F.when(a["at"] <= b["last"], moved).otherwise(a)

    entries = blocks.groupBy(*keys).agg(F.aggregate(chain, state, enter)["entries"].alias("__e")).select(*keys, F.explode("__e").alias("__e"))
    entries = entries.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__e.block").alias("__block"), F.col("__e.entry").alias("entry"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    met = blocks.join(entries, [F.col("block") == F.col("__block"), *same])
    kept = F.array_compact(F.array(F.lit(None).cast(blocks.schema["rows"].dataType.elementType["row"].dataType)))
    state = F.struct(F.col("entry").alias("at"), kept.alias("kept"))
    step = lambda a, x: F.when(x["n"] == a["at"], F.struct(x["next"].alias("at"), F.concat(a["kept"], F.array(x["row"])).alias("kept"))).otherwise(a)
    return met.select(*keys, F.explode(F.aggregate("rows", state, step)["kept"]).alias("__kept")).select(*keys, *[F.col(f"__kept.{c}").alias(c) for c in fields])


def cooldown_fold(trades: DataFrame, *, cooldown: int = 24) -> DataFrame:
    """Trades whose signal does not fall before the last kept trade's exit plus ``cooldown`` bars; the key is the pair."""
    return greedy(trades, PAIR, start="signal_bar", free=F.col("exit_bar") + cooldown, order=["direction"])


def trades_build(signals: DataFrame, legs: DataFrame, *, max_hold: int = 24, cooldown: int = 24, half_spread: float = 0.01, shares: int = 500) -> DataFrame:
    """Trades of signals picked from ``with_exits``: entry on the bar after the signal, exit by reversion (Z),
    resolution (R), hold (T) or the panel's end (P), costs of spreads and four leg fees, profit, without overlapping
    trades of a pair."""
    price = lambda when: [F.col(f"{when}.bar").alias(f"{when}_bar"), *[F.col(f"{when}.{p}").alias(f"{p}_{when}") for p in PRICES]]
    held = _exited(signals, max_hold).select(*PAIR, F.col("bar").alias("signal_bar"), "direction", "status", *price("entry"), *price("exit"))
    held = with_legs(held, legs, "market_spread", "resolution", "fee_rate", "fee_exp")
    resolved = F.col("resolution_short").isNotNull() | F.col("resolution_long").isNotNull()
    held = held.withColumn("status", F.when(F.col("status") == "Z", "Z").when(resolved, "R").otherwise(F.col("status")))
    for side in ("short", "long"):
        final = F.when((F.col("status") == "R") & F.col(f"resolution_{side}").isNotNull(), F.col(f"resolution_{side}")).otherwise(F.col(f"p_{side}_exit"))
        held = held.withColumn(f"p_{side}_exit", final)
    fees = sum((leg_fee(F.col(f"p_{side}_{when}"), F.col(f"fee_rate_{side}"), F.col(f"fee_exp_{side}")) for side in ("short", "long") for when in ("entry", "exit")), F.lit(0.0))
    cost = F.coalesce(F.col("market_spread_short") + F.col("market_spread_long"), F.lit(4 * half_spread)) + fees
    change = (F.col("p_long_exit") - F.col("p_short_exit")) - (F.col("p_long_entry") - F.col("p_short_entry"))
    sign = F.when(F.col("direction") == "BUY", 1.0).otherwise(-1.0)
    held = held.withColumns({"cost": cost, "hold": F.col("exit_bar") - F.col("entry_bar")}).withColumn("pnl", sign * change - F.col("cost"))
    cols = ["signal_bar", "direction", "entry_bar", "exit_bar", "hold", "status", "p_short_entry", "p_long_entry", "p_short_exit", "p_long_exit", "cost", "pnl"]
    return cooldown_fold(held.select(*PAIR, *cols), cooldown=cooldown).withColumn("pnl_dollars", F.col("pnl") * shares)


def trade_summary(trades: DataFrame, *by: str) -> DataFrame:
    """Counts by status, total and mean profit, hit rate over closed trades with a profit or loss, median hold."""
    closed = F.col("status").isin("Z", "R", "T") & (F.col("pnl") != 0)
    return trades.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in "ZRTP"],
        F.count_if(F.col("status").isin("Z", "R", "T")).alias("n_closed"),
        F.sum("pnl").alias("total"),
        F.avg("pnl").alias("mean"),
        F.avg(F.when(closed, (F.col("pnl") > 0).cast("double"))).alias("hit"),
        F.percentile(F.col("hold").cast("double"), F.lit(0.5)).alias("median_hold"),
    )


def tstat(values: Column, least: int = 8) -> Column:
    return F.when(F.count(values) >= least, F.avg(values) / F.nullif(F.stddev_samp(values), F.lit(0.0)) * F.sqrt(F.count(values)))


def event_meta(legs: DataFrame) -> DataFrame:
    """Volume and primary tag of each event: all its legs' liquidity, and the first tag of its first leg."""
    first = F.min_by("tags", "ladder_order")
    return legs.groupBy("event_id").agg(F.sum("liquidity").alias("volume"), F.coalesce(F.nullif(F.element_at(F.split(first, ","), 1), F.lit("")), F.lit("(none)")).alias("primary_tag"))


def trade_buckets(trades: DataFrame, legs: DataFrame) -> DataFrame:
    """primary_tag, tau_bucket (days from the entry to the short leg's deadline, right-closed) and vol_q (quartile of the
    trades' event volumes, missing ones as 0, only if there are four different ones) beside each trade."""
    deadline = legs.select("event_id", F.col("ladder_label").alias("short_dd"), "deadline_date")
    held = trades.join(event_meta(legs), "event_id", "left").join(deadline, ["event_id", "short_dd"], "left")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("entry_bar") / 24).cast("int"))
    tau = F.greatest(F.datediff("deadline_date", day), F.lit(1))
    bucket = F.when(tau <= 7, "<=7d").when(tau <= 30, "8-30d").when(tau <= 90, "31-90d").when(tau <= 365, "91-365d").when(tau <= 9999, ">365d")
    volume = F.coalesce("volume", F.lit(0.0))
    held = written(held.withColumn("known_volume", F.coalesce("volume", F.lit(0.0))), "trade_buckets")  # read for the cuts and for the rows
    cuts = weighted_percentiles(held, [], "known_volume", [0.25, 0.5, 0.75]).select(F.col("percentiles").alias("cuts"))
    several = held.select("volume").distinct().agg(F.count("volume").alias("several"))
    held = held.join(F.broadcast(several)).join(F.broadcast(cuts))  # one row each
    quartile = F.when(volume <= F.col("cuts")[0], "Q1-low").when(volume <= F.col("cuts")[1], "Q2").when(volume <= F.col("cuts")[2], "Q3").otherwise("Q4-high")
    return held.select(*trades.columns, "volume", "primary_tag", bucket.alias("tau_bucket"), F.when(F.col("several") >= 4, quartile).alias("vol_q"))


def top_trades(trades: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best and the ``n`` worst trades, ties by pair and bar."""
    key = [*PAIR, "signal_bar"]
    best = trades.orderBy(F.desc(F.round("pnl_dollars", 6)), *key).limit(n).withColumn("side", F.lit("winner"))
    return best.unionByName(trades.orderBy(F.round("pnl_dollars", 6), *key).limit(n).withColumn("side", F.lit("loser")))


def equity_curve(trades: DataFrame) -> DataFrame:
    """Cumulative profit by exit bar: of all trades, and without those of the event, or the three events, with most
    profit. Profits add up as decimals, so that no order of adding shows."""
    trades = trades.withColumn("pnl_dollars", F.col("pnl_dollars").cast("decimal(28,8)"))
    best = Window.orderBy(F.desc("total"), "event_id")  # over one row an event
    ranks = trades.groupBy("event_id").agg(F.sum("pnl_dollars").alias("total")).select("event_id", F.row_number().over(best).alias("rank"))
    held = trades.join(ranks, "event_id")
    without = lambda k: F.sum(F.when(F.col("rank") > k, F.col("pnl_dollars")).otherwise(F.lit(0).cast("decimal(28,8)")))
    by = held.groupBy("exit_bar").agg(F.sum("pnl_dollars").alias("pnl"), F.count("*").alias("n"), without(1).alias("pnl_x1"), without(3).alias("pnl_x3"))
    run = Window.orderBy("exit_bar").rowsBetween(Window.unboundedPreceding, 0)  # over one row a bar
    return by.select("exit_bar", F.col("pnl").cast("double").alias("pnl"), "n", *[F.sum(c).over(run).cast("double").alias(a) for c, a in (("pnl", "equity"), ("pnl_x1", "equity_x1"), ("pnl_x3", "equity_x3"))])

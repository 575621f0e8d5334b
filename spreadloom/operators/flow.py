"""Fills: signed flow, wallet concentration before a signal, decoding of raw logs, times of blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fills_build(sources: list[DataFrame], legs: DataFrame) -> DataFrame:
    """The fills (asset, side, size, price, sec, ...) of all sources, columns by name and missing ones null, each with the
    leg and outcome whose token its asset is; fills of unknown tokens go."""
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    tokens = F.explode(F.array(F.struct(F.col("yes_token").alias("asset"), F.lit("YES").alias("outcome")), F.struct(F.col("no_token").alias("asset"), F.lit("NO").alias("outcome"))))
    return all_.join(legs.select("event_id", "ladder_label", tokens.alias("t")).select("event_id", "ladder_label", "t.*"), "asset")


def flow_sign(fills: DataFrame) -> DataFrame:
    """The YES price of each fill and its bullish flow: buying YES or selling NO counts up."""
    yes = F.col("outcome") == "YES"
    up = (F.col("side") == "BUY") == yes
    return fills.withColumns({"p_yes": F.when(yes, F.col("price")).otherwise(1 - F.col("price")), "flow": F.when(up, F.col("size")).otherwise(-F.col("size"))})


def flow_concentration(signals: DataFrame, fills: DataFrame, *, seconds: int) -> DataFrame:
    """For each signal (id, event_id, short_dd, long_dd, sec): among fills of either leg in (sec - seconds, sec], the
    largest wallet's share of all wallets' net flow, and the number of wallets.

    Fills and signals meet in blocks of ``seconds``, a signal in its own and the one before: an equi-join with an exact
    filter behind it. A leg's fills are summed by wallet after the filter, so the join's output is its matches only.
    """
    block = lambda c: F.floor(c / seconds)
    legs = signals.withColumn("ladder_label", F.explode(F.array("short_dd", "long_dd"))).withColumn("block", F.explode(F.array(block(F.col("sec")), block(F.col("sec")) - 1)))
    held = flow_sign(fills).select("event_id", "ladder_label", block(F.col("sec")).alias("block"), F.col("sec").alias("at"), "wallet", "flow")
    hits = legs.join(held, ["event_id", "ladder_label", "block"]).where((F.col("at") > F.col("sec") - seconds) & (F.col("at") <= F.col("sec")))
    wallets = hits.groupBy("id", "wallet").agg(F.abs(F.sum("flow")).alias("net"))
    return wallets.groupBy("id").agg(F.count("*").alias("wallets"), (F.max("net") / F.nullif(F.sum("net"), F.lit(0.0))).alias("top_share"))


def leg_depth(fills: DataFrame) -> DataFrame:
    """Span of each leg's fills in days, its wallets and fills."""
    return fills.groupBy("event_id", "ladder_label").agg(((F.max("sec") - F.min("sec")) / 86400.0).alias("days"), F.count_distinct("wallet").alias("wallets"), F.count("*").alias("fills"))


def flow_depth(fills: DataFrame) -> DataFrame:
    """Per event, how far back its legs' fills go: median, tenth percentile and largest span, most wallets, fills."""
    span = lambda share: F.percentile("days", F.lit(share))
    return leg_depth(fills).groupBy("event_id").agg(F.count("*").alias("legs"), span(0.5).alias("median_days"), span(0.1).alias("p10_days"), F.max("days").alias("max_days"), F.max("wallets").alias("most_wallets"), F.sum("fills").alias("fills"))


def universe_fills(fills: DataFrame, legs: DataFrame) -> DataFrame:
    return fills.join(legs, ["event_id", "ladder_label"], "left_semi")


def chainlog_decode(logs: DataFrame, exchange: str) -> DataFrame:
    """Taker fills from raw logs (block hex, tx, topics, data hex): those whose fourth topic is ``exchange``.

    A word is 64 hex digits; amounts use its low 64 bits, ids stay hexadecimal.
    """
    word = lambda i: F.substring("data", 3 + 64 * i, 64)
    low = lambda i: F.conv(F.substring("data", 3 + 64 * i + 48, 16), 16, 10).cast("double")
    held = logs.where((F.size("topics") >= 4) & (F.lower(F.col("topics")[3]) == exchange.lower()) & (F.length("data") >= 2 + 64 * 5))
    buy = low(0) == 0
    held = held.withColumns({"side": F.when(buy, "BUY").otherwise("SELL"), "usdc": F.when(buy, low(2)).otherwise(low(3)) / 1e6, "tokens": F.when(buy, low(3)).otherwise(low(2)) / 1e6})
    return held.where("tokens > 0").select(
        F.conv(F.substring("block", 3, 16), 16, 10).cast("long").alias("block"), "tx", F.concat(F.lit("0x"), F.right(F.col("topics")[2], F.lit(40))).alias("wallet"), word(1).alias("token_id"), "side",
        F.round("tokens", 6).alias("tokens"), F.round("usdc", 6).alias("usdc"), F.round(F.col("usdc") / F.col("tokens"), 6).alias("price"), F.round(low(4) / 1e6, 6).alias("fee"),
    )


def block_time_interp(rows: DataFrame, anchors: DataFrame, *, keys: list[str] | None = None, span: int = 100_000) -> DataFrame:
    """sec of each row's block (row_id, block and ``keys``, such as a chain) by linear interpolation between the anchors
    (block, sec) around it, clamped at the ends. Of an anchor that repeats the smallest time counts.

    An as-of join in ranges of ``span`` blocks: a range's first and last anchor are carried to the ranges around it over
    a table of one row a range, and each range's different blocks meet its own anchors in a sorted pass of at most twice
    ``span`` rows. Rows only join their block's time, so any number of them may share a block.
    """
    keys = keys or []
    place = F.floor(F.col("block") / span).alias("range")
    known = anchors.groupBy(*keys, "block").agg(F.min(F.col("sec").cast("double")).alias("s")).withColumn("anchor", F.struct(F.col("block").cast("long").alias("block"), "s"))
    known = known.select(*keys, place, F.col("block").cast("long").alias("block"), "anchor")
    blocks = rows.select(*keys, place, F.col("block").cast("long").alias("block")).distinct().withColumn("anchor", F.lit(None).cast(known.schema["anchor"].dataType))
    both = known.unionByName(blocks)
    along = Window.partitionBy(*keys)
    up, down = (along.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("range"), F.desc("range")))
    ranges = both.groupBy(*keys, "range").agg(F.min("anchor").alias("first"), F.max("anchor").alias("last"))
    ranges = ranges.select(*keys, "range", F.last("last", ignorenulls=True).over(up).alias("before"), F.last("first", ignorenulls=True).over(down).alias("after"))
    inside = Window.partitionBy(*keys, "range")
    # an anchor stands before its own block in both directions
    up, down = (inside.orderBy(o, F.col("anchor").isNull()).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("block"), F.desc("block")))
    held = both.join(ranges, [*keys, "range"]).withColumns({"a": F.coalesce(F.last("anchor", ignorenulls=True).over(up), "before"), "b": F.coalesce(F.last("anchor", ignorenulls=True).over(down), "after")})
    share = (F.col("block") - F.col("a.block")) / F.nullif(F.col("b.block") - F.col("a.block"), F.lit(0))
    times = held.where("anchor is null").select(*keys, "block", F.coalesce(F.col("a.s") + share * (F.col("b.s") - F.col("a.s")), F.col("a.s"), F.col("b.s")).alias("sec"))
    return rows.join(times, [*keys, "block"]).select("row_id", *keys, "block", "sec")

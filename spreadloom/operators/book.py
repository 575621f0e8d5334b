"""Depth over book snapshots as table jobs: quotes, ladders of both legs, walks within caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positions import wcl_per_share


def best_quotes(book: DataFrame) -> DataFrame:
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    quotes = book.groupBy("token").agg(F.max(F.when(bid, F.col("price"))).alias("bid"), F.min(F.when(ask, F.col("price"))).alias("ask"))
    return quotes.withColumn("width", F.col("ask") - F.col("bid"))


def ranked(book: DataFrame) -> DataFrame:
    best = F.when(F.col("side") == "ask", F.col("price")).otherwise(-F.col("price"))
    return book.withColumn("rank", F.row_number().over(Window.partitionBy("token", "side").orderBy(best)))


def book_top_n(book: DataFrame, n: int = 5) -> DataFrame:
    return ranked(book).where(F.col("rank") <= n)


def combined_ladder(pairs: DataFrame, book: DataFrame) -> DataFrame:
    """Rungs of each pair's entry (id, direction, long_token, short_token): where the size intervals of both legs'
    levels overlap, the cost of a spread share, its depth and notional.

    Levels become intervals of cumulative size. One sorted pass over the places where a level of either leg begins
    carries both legs' prices along, so the work is the sum of both legs' levels, not their product.
    """
    total = F.sum("size").over(Window.partitionBy("token", "side").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    levels = ranked(book.where("size > 0")).select("token", "side", "price", (total - F.col("size")).alias("lo"), total.alias("hi"))
    buy = F.col("direction") == "BUY"
    leg = lambda name, side: pairs.select("id", "direction", F.col(f"{name}_token").alias("token"), side.alias("side")).join(levels, ["token", "side"]).select("id", "direction", F.col("lo").alias("at"), F.col("price").alias(f"p_{name}"), F.col("hi").alias(f"hi_{name}"))
    begins = leg("long", F.when(buy, "ask").otherwise("bid")).unionByName(leg("short", F.when(buy, "bid").otherwise("ask")), allowMissingColumns=True)
    columns = ["p_long", "p_short", "hi_long", "hi_short"]
    begins = begins.groupBy("id", "direction", "at").agg(*[F.max(c).alias(c) for c in columns])  # both legs may begin a level at a place
    along, whole = Window.partitionBy("id").orderBy("at"), Window.partitionBy("id")
    carried = {c: F.last(c, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)) for c in ("p_long", "p_short")}
    ends = {c: F.max(c).over(whole) for c in ("hi_long", "hi_short")}
    both = begins.withColumns(carried | ends | {"next": F.lead("at").over(along)}).where("p_long is not null and p_short is not null")
    both = both.withColumn("end", F.least("hi_long", "hi_short")).where(F.col("at") < F.col("end"))  # of two totals, neither null
    cost = F.when(buy, F.col("p_long") + 1 - F.col("p_short")).otherwise(1 - F.col("p_long") + F.col("p_short"))
    both = both.withColumns({"cost": F.round(cost, 4), "depth": F.least("next", "end") - F.col("at")})
    return both.select("id", "direction", F.row_number().over(along).alias("rung"), "p_long", "p_short", "cost", "depth", F.round(F.col("cost") * F.col("depth"), 2).alias("notional"), "at")


def fee_per_share(price: Column, rate: Column, exponent: Column) -> Column:
    """The same at a price and at the rest of 1; nothing without a rate or at 0 and 1."""
    pq = price * (1 - price)
    return F.when((rate > 0) & (pq > 0), rate * F.pow(pq, exponent)).otherwise(F.lit(0.0))


def book_walk(pairs: DataFrame, book: DataFrame, *, max_dollars: float = 1000.0, max_shares: float = 500.0, ratio: float = 0.0, fraction: float = 0.5, least: int = 10) -> DataFrame:
    """Shares that each pair (with its target ``mu``) may take: rungs in order while their edge after fees is at least
    ``ratio`` times the width of both legs and the fees at the top, within the caps of dollars, shares and the worst
    loss; fewer than ``least`` give none.

    Pairs may have ``fee_rate_long``, ``fee_exp_long`` and the same of the short leg, and ``spread`` with a
    ``wcl_budget``; without them there are no fees and no cap on the loss. A running sum over the rungs replaces the
    walk: what a rung may take is what the caps leave before it. Dollars leave out fees, but each take is divided by the
    cost with them, and repeated on its rung until it is under a share.
    """
    column = lambda name: F.col(name).cast("double") if name in pairs.columns else F.lit(None).cast("double")
    terms = [column(n).alias(n) for n in ("fee_rate_long", "fee_exp_long", "fee_rate_short", "fee_exp_short")]
    a_share = wcl_per_share(F.col("direction"), column("spread"))
    most = F.least(F.lit(float(max_shares)), F.when(a_share > 1e-9, column("wcl_budget") / F.nullif(a_share, F.lit(0.0))))  # skips nulls
    fees = fee_per_share(F.col("p_long"), F.col("fee_rate_long"), F.col("fee_exp_long")) + fee_per_share(F.col("p_short"), F.col("fee_rate_short"), F.col("fee_exp_short"))
    rungs = combined_ladder(pairs, book.withColumn("size", F.col("size") * fraction)).join(pairs.select("id", "mu", most.alias("most"), *terms), "id").withColumn("fee", fees)
    spread = F.col("p_long") - F.col("p_short")
    edge = F.when(F.col("direction") == "BUY", F.col("mu") - spread).otherwise(spread - F.col("mu"))
    order = Window.partitionBy("id").orderBy("rung")
    gate = F.lit(0.0)
    if ratio:
        width = lambda leg: best_quotes(book).select(F.col("token").alias(f"{leg}_token"), F.col("width").alias(f"width_{leg}"))
        widths = pairs.select("id", "long_token", "short_token").join(width("long"), "long_token").join(width("short"), "short_token")
        widths = widths.select("id", (F.col("width_long") + F.col("width_short")).alias("width"))
        rungs = rungs.join(widths, "id").withColumn("full", F.col("width") + F.first("fee").over(order)).where("full > 1e-6")
        gate = ratio * F.col("full")
    rungs = rungs.withColumn("edge", edge - F.col("fee")).withColumn("fails", F.max((F.col("edge") < gate).cast("int")).over(order)).where("fails = 0")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    spent, taken = F.coalesce(F.sum(F.col("cost") * F.col("depth")).over(before), F.lit(0.0)), F.coalesce(F.sum("depth").over(before), F.lit(0.0))
    full = F.col("cost") + F.col("fee")
    once, again = (max_dollars - F.col("spent")) / full, F.col("fee") / full
    times = F.floor(F.when(once >= 1, F.log(once) / -F.log(again))) + 1
    afford = F.when(F.col("fee") > 0, F.when(once >= 1, once * (1 - F.pow(again, times)) / (1 - again)).otherwise(F.lit(0.0))).otherwise(once)
    take = F.greatest(F.lit(0.0), F.least(F.col("depth"), afford, F.col("most") - F.col("taken")))
    rungs = rungs.withColumns({"spent": spent, "taken": taken}).withColumn("take", take).where("take > 0")
    out = rungs.groupBy("id", "direction").agg(F.sum("take").alias("exact"), F.sum(F.col("take") * F.col("cost")).alias("dollars"), (F.sum(F.col("take") * F.col("edge")) / F.sum("take")).alias("avg_edge"), F.max_by("p_long", "rung").alias("worst_long"), F.max_by("p_short", "rung").alias("worst_short"))
    return out.withColumn("shares", F.floor("exact").cast("long")).where(F.col("shares") >= least).drop("exact")


def exit_quotes(due: DataFrame, book: DataFrame) -> DataFrame:
    """Best bids and their sizes for both tokens of due positions; positions without one are left out."""
    top = ranked(book).where("side = 'bid' and rank = 1")
    a = top.select(F.col("token").alias("token_a"), F.col("price").alias("bid_a"), F.col("size").alias("size_a"))
    b = top.select(F.col("token").alias("token_b"), F.col("price").alias("bid_b"), F.col("size").alias("size_b"))
    held = due.join(a, "token_a").join(b, "token_b")
    return held.withColumn("depth_ok", (F.col("size_a") >= F.col("shares")) & (F.col("size_b") >= F.col("shares")))


def loss_budget(plans: DataFrame, *, total: float, per_event: float, least: int = 10) -> DataFrame:
    """Plans (snapshot, seq, event_id, shares, loss: the worst of a share) cut to what their event's budget and the total
    one leave, first come first served; fewer than ``least`` shares are refused and use up nothing.

    One ordered fold over a snapshot's plans, which are few: a handful a snapshot.
    """
    held = plans.groupBy("snapshot").agg(F.array_sort(F.collect_list(F.struct("seq", "event_id", "shares", "loss"))).alias("p"))
    item = held.schema["p"].dataType.elementType.simpleString()
    none = F.lit(None).cast(f"struct<plan:{item},taken:bigint,wcl:double>")
    state = F.struct(F.array_compact(F.array(none)).alias("kept"), F.lit(0.0).alias("used"))

    def step(a: Column, x: Column) -> Column:
        of_event = F.aggregate(F.filter(a["kept"], lambda k: k["plan"]["event_id"] == x["event_id"]), F.lit(0.0), lambda s, k: s + k["wcl"])
        left = F.round(F.least(per_event - of_event, total - a["used"]), 6)
        fits = F.when(x["loss"] > 1e-9, F.floor(F.round(left / F.nullif(x["loss"], F.lit(0.0)), 6))).otherwise(F.floor(x["shares"]))
        taken = F.least(F.floor(x["shares"]), fits).cast("long")
        kept = F.struct(x.alias("plan"), taken.alias("taken"), (taken * x["loss"]).alias("wcl"))
        return F.when((left > 0) & (taken >= least), F.struct(F.concat(a["kept"], F.array(kept)).alias("kept"), (a["used"] + taken * x["loss"]).alias("used"))).otherwise(a)

    out = held.select("snapshot", F.explode(F.aggregate("p", state, step)["kept"]).alias("k"))
    return out.select("snapshot", "k.plan.event_id", "k.plan.seq", F.col("k.taken").alias("shares"), "k.wcl")

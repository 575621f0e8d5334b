"""Mixing sources to target weights by entropy balancing.

A document's rate is the number of its copies in the mix. Of all rates between 0 and ``MOST`` that give every source its
target number of tokens, those closest to 1 in relative entropy are exponentially tilted: ``min(MOST, exp(a * size))``
with one multiplier ``a`` a source. The dual in ``a`` is convex; its gradient is the tokens taken less the target and is
found by Newton's steps, kept between the multipliers known to be too small and too large.

Documents of one source and size have one rate, so the steps run over counts of (source, size), added up before any
shuffle, in joins and groupings by source. Sums are decimals, so no order of adding changes a result. Rates then become
copies: over a source's sizes, largest first, running sums of rates are rounded, which is off by less than one copy at
every size; what remains of the target is settled by a few sizes that fit it. A size's copies are dealt over its
documents by a hash of id and text, in buckets of a bounded number of documents, so that a hot size is split.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, table, written

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BUCKET = 5000  # documents that are ordered together
STEPS, SETTLES = 100, 6  # Newton's steps at most (bisection takes over in between), sizes that settle a source's rest
CLOSE = 0.25  # tokens
EXACT = "decimal(38,9)"
BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The number of words; null and empty texts have none."""
    marked = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "a")
    return F.coalesce(F.length(F.translate(marked, BLANKS, "")), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a hash that orders documents of one size. A written table."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return written(kept.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("order")), "sized")


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size and target of every source, from counts of tokens by source (source, source_size).

    Weights are dealt to sources in turn, by code point, null last. A target is the smaller of ``most`` times the
    source's size and a common level times its weight; the level is where the targets add up.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most))
    order = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    ahead, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    exact = lambda c: F.col(c).cast(EXACT)
    left = F.sum(exact("source_size")).over(Window.partitionBy()) * share - F.coalesce(F.sum(exact("limit")).over(ahead), F.lit(0))
    rows = rows.withColumn("level", (left / F.sum(exact("weight")).over(behind)).cast("double"))
    # levels rise while the sources ahead are rightly at their limits, and fall from there on
    level = F.max("level").over(Window.partitionBy())
    return rows.withColumn("target", F.least(level * F.col("weight"), F.col("limit"))).select("source", "source_size", "target")


def rate(multiplier: Column, size: Column, most: float) -> Column:
    """min(most, exp(multiplier * size)); without a multiplier the limit."""
    return F.when(multiplier.isNull(), F.lit(float(most))).otherwise(F.least(F.exp(F.least(multiplier * size, F.lit(50.0))), F.lit(float(most))))


def multipliers(cells: DataFrame, goals: DataFrame, *, most: float = MOST, steps: int = STEPS) -> DataFrame:
    """source and multiplier, null for sources that are taken to their limit. ``cells``: source, size, n of sizes over
    0; ``goals``: source, source_size, target. A written table."""
    open_ = F.col("target") < F.col("source_size") * float(most) - CLOSE
    nothing = F.lit(None).cast("double")
    state = written(goals.where("source_size > 0").select("source", "target", F.when(open_, 0.0).alias("multiplier"), nothing.alias("low"), nothing.alias("high"), (~open_).alias("done")), "multipliers")
    size = F.col("size").cast("double")
    for _ in range(steps):
        w = rate(F.col("multiplier"), size, most)
        pull = F.when(w < most, w).otherwise(0.0)
        sums = cells.join(state.where("not done"), F.expr("cells_source <=> source")).groupBy("cells_source").agg(F.sum((w * size * F.col("n")).cast(EXACT)).cast("double").alias("taken"), F.sum((pull * size * size * F.col("n")).cast(EXACT)).cast("double").alias("slope"))
        now = state.join(sums, F.expr("source <=> cells_source"), "left")
        off, at = F.col("taken") - F.col("target"), F.col("multiplier")
        now = now.withColumn("low", F.when(off < 0, at).otherwise(F.col("low"))).withColumn("high", F.when(off > 0, at).otherwise(F.col("high")))
        newton = at - off / F.expr("nullif(slope, 0)")
        inside = newton.isNotNull() & F.coalesce(newton > F.col("low"), F.lit(True)) & F.coalesce(newton < F.col("high"), F.lit(True))
        moved = F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        finished = F.col("done") | (F.abs(off) <= CLOSE) | (moved == at)
        step = written(now.select("source", "target", F.when(finished, at).otherwise(moved).alias("multiplier"), "low", "high", finished.alias("done")), "multipliers")
        discard(state)
        state = step
        if state.where("not done").isEmpty():
            break
    return state.select("source", "multiplier")


def copies(cells: DataFrame, rates: DataFrame, goals: DataFrame, *, most: float = MOST, settles: int = SETTLES) -> DataFrame:
    """source, size, n and the copies of all n documents together, at most ``most`` times n. A written table."""
    fair = rate(F.col("multiplier"), F.col("size").cast("double"), most) * F.col("n")
    before = Window.partitionBy("cells_source").orderBy(F.col("size").desc())
    rows = cells.join(rates, F.expr("cells_source <=> source"), "left").withColumn("fair", fair.cast(EXACT)).drop("source", "multiplier")
    upto = lambda w: F.floor(F.coalesce(F.sum("fair").over(w), F.lit(0)) + F.lit(0.5))
    rows = rows.withColumn("copies", (upto(before.rowsBetween(Window.unboundedPreceding, 0)) - upto(before.rowsBetween(Window.unboundedPreceding, -1))).cast("long"))
    rows = rows.withColumn("copies", F.least("copies", (F.col("n") * most).cast("long"))).drop("fair")
    goals = goals.select(F.col("source").alias("goal_source"), "target")
    rows = rows.join(goals, F.expr("cells_source <=> goal_source"), "left").drop("goal_source")
    whole = Window.partitionBy("cells_source")
    for _ in range(settles):  # the largest size that fits the rest takes as much of it as it can
        rest = F.col("target") - F.sum((F.col("copies") * F.col("size")).cast("decimal(38,0)")).over(whole).cast("double")
        rows = rows.withColumn("rest", rest)
        room = F.when(F.col("rest") >= 0, (F.col("n") * most).cast("long") - F.col("copies")).otherwise(F.col("copies"))
        rows = rows.withColumn("step", F.least(room, F.floor(F.abs("rest") / F.col("size"))))
        chosen = F.max(F.when(F.col("step") > 0, F.col("size"))).over(whole)
        change = F.when(F.col("size") == chosen, F.col("step") * F.signum("rest").cast("long")).otherwise(0)
        rows = rows.withColumn("copies", (F.col("copies") + change).cast("long")).drop("rest", "step")
    return written(rows.select("cells_source", "size", "n", "copies", "target"), "copies")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies times size) of every row of ``docs``.

    Documents without words (null, empty or blank texts) have a rate of 1 and take nothing. A null source is a source,
    null ids are kept. Rows that repeat an id and text are ordered together; which of them are copied makes no
    difference. Ties of the hash go to the smaller id. A text of any length counts whole; an empty table gives no rows.
    Columns beside doc_id, source and text are ignored.
    """
    docs = sized(docs)
    cells = written(docs.groupBy(F.col("source").alias("cells_source"), "size").agg(F.count("*").alias("n")), "cells")
    goals = written(targets(cells.groupBy(F.col("cells_source").alias("source")).agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights=weights, share=share, most=most), "goals")
    worded = cells.where("size > 0")
    dealt = copies(worded, multipliers(worded, goals, most=most), goals, most=most)
    dealt = dealt.drop("target").unionByName(cells.where("size = 0").withColumn("copies", F.col("n")))
    dealt = dealt.withColumnRenamed("size", "cells_size").withColumn("buckets", F.ceil(F.col("n") / BUCKET))
    rows = docs.join(dealt, F.expr("source <=> cells_source and size = cells_size")).withColumn("bucket", F.pmod(F.xxhash64("order", "size"), "buckets"))
    filled = rows.groupBy("cells_source", "size", "bucket").agg(F.count("*").alias("held"), F.first("n").alias("n"), F.first("copies").alias("copies"))
    running = Window.partitionBy("cells_source", "size").orderBy("bucket")
    part = lambda w: F.floor(F.coalesce(F.sum("held").over(w), F.lit(0)).cast("decimal(38,0)") * F.col("copies") / F.col("n"))
    mine = part(running.rowsBetween(Window.unboundedPreceding, 0)) - part(running.rowsBetween(Window.unboundedPreceding, -1))
    filled = filled.withColumn("mine", mine.cast("long")).select(F.col("cells_source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("b"), "held", "mine")
    ranked = rows.select("doc_id", "source", "size", "order", "bucket").withColumn("place", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("order", "doc_id")))
    ranked = ranked.join(filled, F.expr("source <=> s and size = z and bucket = b"))
    number = F.floor(F.col("mine") / F.col("held")) + F.when(F.col("place") <= F.col("mine") % F.col("held"), 1).otherwise(0)
    goals = goals.withColumnRenamed("source", "g")
    out = ranked.withColumn("copies", number.cast("long")).join(goals, F.expr("source <=> g"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))

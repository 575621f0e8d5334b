"""Exact percentiles without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY, MARGIN, FEW = 10_000, 0.0025, 1000


def _same(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Joined on ``by``, nulls equal; without columns ``right`` is one row."""
    if not by:
        return left.join(F.broadcast(right))  # one row
    other = right.withColumnsRenamed({c: f"__{c}" for c in by})
    return left.join(other, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], how).drop(*[f"__{c}" for c in by])


def exact_percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """``by``, n and percentiles (an array in the order of ``shares``) of the values that are not null, interpolated
    between neighbours as ``percentile`` does.

    A sketch of bounded size brackets every percentile: its error is at most 1 / ``ACCURACY`` of a group's rows, and the
    bracket is ``MARGIN`` to either side. Values below a bracket are only counted; those inside, about one in two
    hundred, are counted by value before the shuffle and numbered by a running sum. Groups of up to ``FEW`` rows are
    bracketed as a whole. So a task holds sketches and counts, never a group.
    """
    v = F.col(value).cast("double")
    rows = rows.select(*by, v.alias("__v")).where("__v is not null")
    sides = [s for p in shares for s in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    sketch = F.percentile_approx("__v", [float(s) for s in sides], ACCURACY)
    groups = rows.groupBy(*by).agg(F.count("*").alias("n"), sketch.alias("s"), F.min("__v").alias("least"), F.max("__v").alias("most"))
    few = F.col("n") <= FEW
    # a share so close to an end that its bracket would pass it takes the end itself
    bracket = lambda i, p: F.struct(F.lit(i).alias("i"), F.when(few | F.lit(p <= MARGIN), F.col("least")).otherwise(F.col("s")[2 * i]).alias("lo"), F.when(few | F.lit(p >= 1 - MARGIN), F.col("most")).otherwise(F.col("s")[2 * i + 1]).alias("hi"))
    groups = groups.select(*by, "n", F.array(*[bracket(i, p) for i, p in enumerate(shares)]).alias("b")).where("n > 0")
    met = _same(rows, groups, by)
    below = met.groupBy(*by, "n").agg(F.array(*[F.count_if(F.col("__v") < F.col("b")[i]["lo"]) for i in range(len(shares))]).alias("below"))
    inside = met.select(*by, "__v", F.explode(F.transform(F.filter("b", lambda x: (F.col("__v") >= x["lo"]) & (F.col("__v") <= x["hi"])), lambda x: x["i"])).alias("i"))
    counts = inside.groupBy(*by, "i", "__v").agg(F.count("*").alias("c"))
    run = Window.partitionBy(*by, "i").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    counts = _same(counts.withColumn("upto", F.sum("c").over(run)), below, by).withColumn("upto", F.col("upto") + F.get("below", F.col("i")))
    share = F.get(F.array(*[F.lit(float(p)) for p in shares]), F.col("i"))
    at = share * (F.col("n") - 1)
    covers = lambda rank: (F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto"))
    low, high = F.max(F.when(covers(F.floor(at)), F.col("__v"))), F.max(F.when(covers(F.ceil(at)), F.col("__v")))
    found = counts.groupBy(*by, "n", "i").agg(low.alias("low"), high.alias("high"))
    part = at - F.floor(at)
    value_at = F.when(F.col("low").isNull() | F.col("high").isNull(), F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * part)
    out = found.select(*by, "n", F.struct("i", value_at.alias("p")).alias("x")).groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"]).alias("percentiles"))
    return out


def weighted_percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """The same for values of which few differ: all are counted by value, none is bracketed."""
    v = F.col(value).cast("double")
    counts = rows.select(*by, v.alias("__v")).where("__v is not null").groupBy(*by, "__v").agg(F.count("*").alias("c"))
    whole = Window.partitionBy(*by)
    counts = counts.withColumns({"upto": F.sum("c").over(whole.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(whole)})
    covers = lambda rank: (F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto"))
    ends = lambda p: [F.max(F.when(covers(r(F.col("n") * p - p)), F.col("__v"))) for r in (F.floor, F.ceil)]
    part = lambda p: F.max(F.col("n") * p - p - F.floor(F.col("n") * p - p))
    values = [(lambda lo, hi: lo + (hi - lo) * part(p))(*ends(p)) for p in map(float, shares)]
    return counts.groupBy(*by).agg(F.max("n").alias("n"), F.array(*values).alias("percentiles"))

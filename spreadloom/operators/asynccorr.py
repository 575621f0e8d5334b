"""Covariance of series that change at different times (Hayashi and Yoshida), and correlations on common bars."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from .text import components, near_dup

if TYPE_CHECKING:
    import pandas as pd


def change_points(points: DataFrame) -> DataFrame:
    """Points of series (series, t, seq, p) whose value differs from the one before; ``k`` numbers them."""
    w = Window.partitionBy("series").orderBy("t", "seq")
    held = points.withColumn("before", F.lag("p").over(w)).where(F.col("before").isNull() | (F.col("p") != F.col("before")))
    return held.drop("before").withColumn("k", F.row_number().over(w))


def returns(changes: DataFrame) -> DataFrame:
    """Intervals (a, b] of each series with their change d."""
    w = Window.partitionBy("series").orderBy("k")
    held = changes.select("series", F.lag("t").over(w).alias("a"), F.col("t").alias("b"), (F.col("p") - F.lag("p").over(w)).alias("d"))
    return held.where("a is not null")


def realised_var(rets: DataFrame) -> DataFrame:
    return rets.groupBy("series").agg(F.sum(F.col("d") * F.col("d")).alias("rv"))


def hy_cov(rets: DataFrame, pairs: DataFrame) -> DataFrame:
    """x, y, cov of series pairs: the sum of products of changes over overlapping intervals.

    An interval of x overlaps those of y between two bounds in time, so its partners' sum is a difference of running
    sums. Both bounds of all intervals come from one sorted union a pair: n log n in place of all overlaps.
    """
    x = pairs.join(rets.withColumnRenamed("series", "x"), "x")
    y = pairs.join(rets.withColumnRenamed("series", "y"), "y")
    # ended: changes of y with b <= x.a; begun: changes of y with a < x.b
    ended = x.select("x", "y", F.col("a").alias("t"), F.lit(1).alias("side"), F.lit(0.0).alias("dy"), F.col("d").alias("dx"), F.lit(-1).alias("sign")).unionByName(y.select("x", "y", F.col("b").alias("t"), F.lit(0).alias("side"), F.col("d").alias("dy"), F.lit(None).cast("double").alias("dx"), F.lit(-1).alias("sign")))
    begun = x.select("x", "y", F.col("b").alias("t"), F.lit(0).alias("side"), F.lit(0.0).alias("dy"), F.col("d").alias("dx"), F.lit(1).alias("sign")).unionByName(y.select("x", "y", F.col("a").alias("t"), F.lit(1).alias("side"), F.col("d").alias("dy"), F.lit(None).cast("double").alias("dx"), F.lit(1).alias("sign")))
    w = Window.partitionBy("x", "y", "sign").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    sums = ended.unionByName(begun).withColumn("sum_y", F.sum("dy").over(w)).where("dx is not null")
    return sums.groupBy("x", "y").agg(F.sum(F.col("sign") * F.col("dx") * F.col("sum_y")).alias("cov"))


def hy_corr(rets: DataFrame, pairs: DataFrame) -> DataFrame:
    rv = realised_var(rets)
    held = hy_cov(rets, pairs).join(rv.withColumnsRenamed({"series": "x", "rv": "vx"}), "x").join(rv.withColumnsRenamed({"series": "y", "rv": "vy"}), "y").where("vx > 0 and vy > 0")
    rho = F.col("cov") / F.sqrt(F.col("vx") * F.col("vy"))
    return held.select("x", "y", "cov", F.least(F.greatest(rho, F.lit(-0.999)), F.lit(0.999)).alias("rho"))


DAY = 86_400_000_000  # microseconds


def correlated_clusters(corr: DataFrame, *, least: float) -> DataFrame:
    """cluster, series: components of the graph of series pairs (x, y, changes) whose correlation is ``least`` or more in
    size. A cluster has the name of its smallest series."""
    edges = corr.where(F.abs("changes") >= least).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return components(edges).select(F.col("component").alias("cluster"), F.col("id").alias("series"))


def _sweep(key: tuple, asks: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
    """Sums over one block of series, of changes times what the series of the other block have run up to then."""
    import numpy as np
    import pandas as pd

    cluster, _, _, begun, _ = key
    names, code = np.unique(asks["series"].to_numpy(str), return_inverse=True)
    t, d, out = asks["t"].to_numpy(), asks["d"].to_numpy(), []
    for y, own in points.sort_values("t", kind="stable").groupby("series"):
        run = np.concatenate([[0.0], own["d"].cumsum()])
        upto = np.searchsorted(own["t"].to_numpy(), t, "left" if begun else "right")
        sums = np.bincount(code, d * run[upto], len(names)) * (1 if begun else -1)
        out += [(cluster, x, y, s) for x, s in zip(names, sums, strict=True) if x < y]
    return pd.DataFrame(out, columns=["cluster", "x", "y", "part"])


#: Changes of a block of series within a span that a task holds, about, and how often a span may be halved for it.
CHANGES, HALVINGS = 250_000, 20


def _fitting(rows: DataFrame, span: int, most: int) -> int:
    """``span``, halved until no block's changes within a span are more than ``most``; at most ``HALVINGS`` times."""
    finest = max(1, span >> HALVINGS)
    counts = rows.groupBy("cluster", "block", F.floor(F.col("b") / finest).alias("at")).agg(F.count("*").alias("n"))
    levels = counts.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(HALVINGS))))
    whole = levels.groupBy("cluster", "block", "level", F.floor(F.col("at") / F.pow(F.lit(2.0), F.col("level"))).alias("at"))
    largest = {r["level"]: r["n"] for r in whole.agg(F.sum("n").alias("n")).groupBy("level").agg(F.max("n").alias("n")).collect()}
    fits = [k for k, n in largest.items() if n <= most]
    return min(span, finest << max(fits, default=0))


def hy_cov_clusters(rets: DataFrame, members: DataFrame, *, block: int = 32, span: int = DAY, most: int = CHANGES) -> DataFrame:
    """cluster, x, y, cov of all pairs x < y of a cluster's series (cluster, series): the sum of products of changes over
    overlapping intervals.

    An interval of x overlaps those of y that have begun before its end, less those that have ended by its start. Blocks
    of ``block`` series meet blocks of the same cluster within ``span`` of time: a block's points are sorted and summed
    up once for all series of the other block, so a change is moved once a block and not once a partner. What a series
    has run up to before a span comes along as one point, from sums a span that run over all spans. A task holds two
    blocks' changes in one span; where those would be more than ``most`` a block, spans are halved until they aren't.
    """
    number = F.row_number().over(Window.partitionBy("cluster").orderBy("series")) - 1
    placed = members.select("cluster", "series", F.floor(number / block).cast("int").alias("block"))
    blocks = placed.groupBy("cluster").agg(F.max("block").alias("blocks"))
    rows = rets.join(placed, "series").join(blocks, "cluster")
    span = _fitting(rows, span, most)
    spans = lambda t: F.floor(F.col(t) / span)
    both = lambda begun, ended: F.array(F.struct(F.lit(True).alias("begun"), F.col(begun).alias("t")), F.struct(F.lit(False).alias("begun"), F.col(ended).alias("t")))
    columns = ["cluster", "series", "block", "blocks", "e.begun", "e.t", "d"]
    asks = rows.withColumn("e", F.explode(both("b", "a"))).select(*columns).withColumn("chunk", spans("t"))
    points = rows.withColumn("e", F.explode(both("a", "b"))).select(*columns).withColumn("chunk", spans("t"))
    grid = asks.select("cluster", "begun", "chunk").distinct().join(placed.join(blocks, "cluster"), "cluster")
    sums = points.groupBy("cluster", "series", "begun", "chunk").agg(F.sum("d").alias("d"))
    known = [*sums.columns[:3], "chunk"]
    every = grid.select(*known).unionByName(sums.select(*known)).distinct().join(sums, known, "left").join(placed.join(blocks, "cluster"), ["cluster", "series"])
    before = Window.partitionBy("cluster", "series", "begun").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("d", F.sum("d").over(before)).where("d is not null").withColumn("t", F.lit(-(1 << 62)))
    points = points.unionByName(carried.select(points.columns))
    left = asks.withColumn("other", F.explode(F.sequence("block", "blocks"))).select("cluster", F.col("block").alias("i"), F.col("other").alias("j"), "begun", "chunk", "series", "t", "d")
    right = points.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("block")))).select("cluster", F.col("other").alias("i"), F.col("block").alias("j"), "begun", "chunk", "series", "t", "d")
    keys = ["cluster", "i", "j", "begun", "chunk"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # of one origin, so named anew
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_sweep, "cluster string, x string, y string, part double")
    return parts.groupBy("cluster", "x", "y").agg(F.sum("part").alias("cov"))


def hy_corr_matrix(rets: DataFrame, members: DataFrame, *, least_changes: int = 1, block: int = 32, span: int = DAY) -> DataFrame:
    """cluster, x, y, rho of all pairs inside clusters, of series with ``least_changes`` changes or more."""
    rv = rets.groupBy("series").agg(F.sum(F.col("d") * F.col("d")).alias("rv"), F.count("*").alias("n")).where(F.col("n") >= least_changes)
    cov = hy_cov_clusters(rets, members.join(rv.select("series"), "series"), block=block, span=span)
    held = cov.join(rv.select(F.col("series").alias("x"), F.col("rv").alias("vx")), "x").join(rv.select(F.col("series").alias("y"), F.col("rv").alias("vy")), "y").where("vx > 0 and vy > 0")
    rho = F.col("cov") / F.sqrt(F.col("vx") * F.col("vy"))
    return held.select("cluster", "x", "y", F.least(F.greatest(rho, F.lit(-0.999)), F.lit(0.999)).alias("rho"))


def cluster_report(r2: DataFrame, members: DataFrame, *, words: int = 3) -> DataFrame:
    """Per cluster: series, median and largest r2 of ``r2`` (cluster, series, r2), the commonest category and the
    commonest words of its members' stems (cluster, series, category, stem), ties by name. Words are longer than two
    letters, no stop words and no numbers."""
    facts = r2.groupBy("cluster").agg(F.count("*").alias("n"), F.percentile("r2", F.lit(0.5)).alias("median_r2"), F.max("r2").alias("max_r2"))
    first = lambda column, n: F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("count"), column)) <= n
    best = members.groupBy("cluster", "category").count().withColumn("first", first("category", 1)).where("first").select("cluster", "category")
    token = members.select("cluster", F.explode(F.split(F.lower("stem"), " ")).alias("word")).where((F.length("word") > 2) & ~F.col("word").isin(STOP_WORDS) & (F.translate("word", "0123456789.", "") != ""))
    top = token.groupBy("cluster", "word").count().withColumn("first", first("word", words)).where("first")
    label = top.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "word"))), lambda x: x["word"]), " ").alias("label"))
    return facts.join(best, "cluster", "left").join(label, "cluster", "left")


def loo_r2(corr: DataFrame, *, most: int = 2000, shrink: float = 0.1) -> DataFrame:
    """series, r2 of each cluster's correlation matrix (cluster, x, y, rho): 1 - 1 / diagonal of its inverse, after
    clipping eigenvalues at 0.001, a unit diagonal and shrinkage to the identity. A cluster is one matrix, so clusters
    of more than ``most`` series are refused."""
    import numpy as np
    import pandas as pd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf.x) | set(pdf.y))
        if len(names) > most:
            raise ValueError(f"a cluster of {len(names)} series; at most {most}")
        at = {n: i for i, n in enumerate(names)}
        c = np.eye(len(names))
        for x, y, r in zip(pdf.x, pdf.y, pdf.rho, strict=True):
            c[at[x], at[y]] = c[at[y], at[x]] = r
        values, vectors = np.linalg.eigh(c)
        c = (vectors * np.clip(values, 1e-3, None)) @ vectors.T
        scale = np.sqrt(np.diag(c))
        c = (1 - shrink) * c / np.outer(scale, scale) + shrink * np.eye(len(names))
        return pd.DataFrame({"cluster": pdf.cluster.iloc[0], "series": names, "r2": 1 - 1 / np.diag(np.linalg.inv(c))})

    return corr.select("cluster", "x", "y", "rho").groupBy("cluster").applyInPandas(solve, "cluster string, series string, r2 double")


def pair_corr(bars: DataFrame, pairs: DataFrame, *, least: int = 72, least_changes: int = 48) -> DataFrame:
    """Correlation of changes and of levels of series pairs (x, y) on their common bars (series, bar, p), and each
    series' last value."""
    both = pairs.join(bars.withColumnsRenamed({"series": "x", "p": "px"}), "x").join(bars.withColumnsRenamed({"series": "y", "p": "py"}), ["y", "bar"])
    w = Window.partitionBy("x", "y").orderBy("bar")
    both = both.withColumns({"dx": F.col("px") - F.lag("px").over(w), "dy": F.col("py") - F.lag("py").over(w)})
    enough = (F.count("dx") >= least_changes) & (F.stddev_samp("dx") > 0) & (F.stddev_samp("dy") > 0)
    out = both.groupBy("x", "y").agg(F.count("*").alias("n"), F.corr("px", "py").alias("level"), F.when(enough, F.corr("dx", "dy")).alias("changes")).where(F.col("n") >= least)
    last = bars.groupBy("series").agg(F.max_by("p", "bar").alias("last"))
    return out.join(last.withColumnsRenamed({"series": "x", "last": "last_x"}), "x").join(last.withColumnsRenamed({"series": "y", "last": "last_y"}), "y")


def pairs_resolve(claims: DataFrame, dimension: DataFrame) -> DataFrame:
    """Claims (x, y, ...) with both series' columns of a dimension (id, stem, ...), without claims of a series about
    itself, unknown series and pairs whose stems are near duplicates."""
    rest = [c for c in dimension.columns if c not in ("id", "stem")]
    side = lambda x, t: dimension.select(F.col("id").alias(x), F.col("stem").alias(t), *[F.col(c).alias(f"{c}_{x}") for c in rest])
    held = claims.where("x <> y").join(side("x", "ta"), "x").join(side("y", "tb"), "y")
    return held.join(near_dup(held.select("x", "y", "ta", "tb")).select("x", "y"), ["x", "y"], "left_anti").withColumnsRenamed({"ta": "stem_x", "tb": "stem_y"})


def sign_agreement(corr: DataFrame, claims: DataFrame) -> DataFrame:
    """Whether the sign of each pair's correlation is the claimed one."""
    return corr.join(claims, ["x", "y"]).withColumn("agrees", F.signum("changes") == F.col("sign"))


def date_matched_pairs(contracts: DataFrame, relations: DataFrame, bars: DataFrame, *, as_of: str, least: float, **more: int) -> DataFrame:
    """Pairs of contracts of the same month within relations of underlyings, whose correlation is over ``least`` in size.

    Of contracts (category, stem, deadline, volume, series) that are alive on ``as_of`` the one with most volume stands for
    a (category, stem, month), ties to the smaller series. Relations (category, stem_a, stem_b, sign) of stems that are
    near duplicates are left out. ``bars`` (series, bar, p) are correlated for the pairs that are left, each once.
    """
    live = contracts.where((F.col("deadline") >= F.lit(as_of).cast("date")) & F.col("series").isNotNull())
    best = F.max_by(F.struct("series", "volume"), F.struct(F.coalesce("volume", F.lit(-1.0)), F.expr("-rank")))
    ranked = live.withColumn("month", F.date_format("deadline", "yyyy-MM")).withColumn("rank", F.row_number().over(Window.partitionBy("category", "stem", F.date_format("deadline", "yyyy-MM")).orderBy("series")))
    chosen = ranked.groupBy("category", "stem", "month").agg(best.alias("best")).select("category", "stem", "month", F.col("best.series").alias("series"))
    side = lambda x: chosen.select("category", "month", F.col("stem").alias(f"stem_{x}"), F.col("series").alias({"a": "x", "b": "y"}[x]))
    kept = relations.where("stem_a <> stem_b")
    same = near_dup(kept.select(F.col("stem_a").alias("ta"), F.col("stem_b").alias("tb")).distinct()).select(F.col("ta").alias("stem_a"), F.col("tb").alias("stem_b"))
    kept = kept.join(same, ["stem_a", "stem_b"], "left_anti")
    pairs = kept.join(side("a"), ["category", "stem_a"]).join(side("b"), ["category", "stem_b", "month"]).where("x <> y")
    pairs = pairs.groupBy("x", "y").agg(F.min(F.struct("category", "month", "stem_a", "stem_b", "sign")).alias("r")).select("x", "y", "r.*")
    corr = pair_corr(bars, pairs.select("x", "y"), **more).where(F.abs("changes") > least)
    return pairs.join(corr, ["x", "y"]).withColumn("agrees", F.signum("changes") == F.col("sign"))

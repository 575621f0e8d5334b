"""Nearest neighbours from balanced posting lists, held by a graph of centroids.

Centroids are fitted on a bounded sample (``SAMPLE`` vectors) by k-means with a penalty for full clusters; every vector
is indexed. A vector near a border goes to each of its up to ``COPIES`` closest lists whose centroid is at most
``BORDER`` times as far as the closest one. A query finds its lists through a neighbour graph of the centroids, kept in
memory by each task, and visits those whose distance is at most ``PRUNE`` times the smallest, and further ones until
they are the home (closest list) of at least ``K + 1`` entries. Queries that still find fewer than ``K`` although there
are more visit all lists. Lists and visits meet in a join on the list; scores are exact inner products of the original vectors in double precision.

Vectors of different length are compared as unit vectors with one more coordinate that makes all lengths equal. A query
is its own direction with 0 as that coordinate, so that the closest are those with the largest inner product. Equal vectors are one entry with its ``K + 1`` smallest ids, which
is all that any list of K can hold; so a vector that recurs a million times costs one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

K, EVERY = 20, 20
SAMPLE, LISTS = 20_000, 256  # the bound of the fitting sample, and the most lists; both bound what tasks hold
COPIES, BORDER = 4, 1.15
VISITS, PRUNE, DEGREE = 56, 1.6, 16
BLOCK, QUERIES = 4096, 256  # entries of a list and queries scored together


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and x (doubles) of vectors that are not null, empty or zero and hold only finite numbers."""
    x = F.col(embedding).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(finite & F.exists("x", lambda v: v != 0))


class Lists:
    """Centroids and their neighbour graph."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int = 9):
        self.longest = longest
        points = self.lift(sample)
        rng = np.random.default_rng(seed)
        k = int(max(1, min(LISTS, len(points) // 30)))
        centres = points[rng.choice(len(points), k, replace=False)]
        load = np.full(k, len(points) / k)
        for step in range(16):
            far = self.distances(points, centres)
            near = (far * (1 + 0.15 * np.log(np.maximum(load, 1) * k / len(points)).clip(-1, 2))).argmin(1)  # full clusters seem farther
            load = np.bincount(near, minlength=k).astype(float)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, points)
            centres = np.where(load[:, None] > 0, sums / np.maximum(load, 1)[:, None], centres)
            if step < 12:  # centroids of the emptiest clusters move into the fullest
                order = np.argsort(load, kind="stable")
                for small, large in zip(order[: k // 8], order[::-1], strict=False):
                    if load[large] > 2 * len(points) / k:
                        centres[small] = points[rng.choice(np.flatnonzero(near == large))]
        self.centres = centres
        far = self.distances(centres, centres)
        close = far.argsort(1, kind="stable")[:, 1 : DEGREE + 1]
        links = [set(x.tolist()) | {(i + 1) % k} for i, x in enumerate(close)]  # the ring keeps the graph in one piece
        for i, x in enumerate(close):
            for j in x:
                links[j].add(i)
        self.graph = [np.array(sorted(x)) for x in links]
        self.entries = np.arange(0, k, max(1, k // 16))

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))])

    @staticmethod
    def aim(q: np.ndarray) -> np.ndarray:
        """The queries' points: 2 - 2 (q / |q|) x / longest from the point of a candidate x."""
        q = q / np.abs(q).max(1, keepdims=True)  # its square can't overflow or vanish
        return np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))])

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)

    def closest(self, point: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walk over the graph: the closest centroids found and their distances."""
        seen = np.zeros(len(self.centres), bool)
        ids, front = np.zeros(0, int), np.array(self.entries)
        dist = np.zeros(0)
        while len(front):
            seen[front] = True
            ids = np.concatenate([ids, front])
            dist = np.concatenate([dist, ((self.centres[front] - point) ** 2).sum(1)])
            best = np.argsort(dist, kind="stable")[: 2 * most]
            ids, dist = ids[best], dist[best]
            around = np.unique(np.concatenate([self.graph[i] for i in ids[:most]]))
            front = around[~seen[around]]
        return ids[:most], dist[:most]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _products(q: np.ndarray, x: np.ndarray) -> Iterator[np.ndarray]:
    """Each query's inner products with all entries; those of ``QUERIES`` queries are held at a time."""
    for begin in range(0, len(q), QUERIES):
        yield from q[begin : begin + QUERIES] @ x.T


def fit(entries: DataFrame, *, sample: int = SAMPLE) -> Lists | None:
    """Lists from at most ``sample`` entries, those with the least hash of their id."""
    longest = entries.agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)))).first()[0]
    rows = entries.select("first", "x").orderBy(F.xxhash64("first"), "first").limit(sample).toPandas()
    return Lists(np.stack(rows["x"].to_numpy()), longest * (1 + 1e-12)) if len(rows) else None


def nearest(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each vector whose id is divisible by ``every``.

    Vectors that are null, empty, zero or hold null or non-finite numbers take no part, nor do null ids. Of rows that
    repeat an id and a vector one counts; an id with two vectors is two candidates. Vectors of a length other than the
    commonest never meet the others. Ties go to the smaller id. Other columns are ignored.
    """
    spark = vectors.sparkSession
    held = usable(vectors, vec_id, embedding)
    size = held.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = held.where(F.size("x") == size[0]["d"])
    key = F.sha2(F.concat_ws(",", F.col("x").cast("array<string>")), 256)
    pairs = held.select(key.alias("key"), "vec_id", "x")
    ids = pairs.groupBy("key").agg(F.min("vec_id").alias("first"), F.any_value("x").alias("x"), F.count_distinct("vec_id").alias("copies"))
    # the k + 1 smallest ids of a vector: enough for every query's k, itself left out
    many = pairs.select("key", "vec_id").distinct().join(ids.where("copies > 1").select("key"), "key")
    many = many.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    smallest = lambda c: F.slice(F.sort_array(c), 1, k + 1)
    few = _smallest(many, k + 1)
    entries = written(ids.join(few, "key", "left").select("first", "x", F.coalesce(smallest("ids"), F.array("first")).alias("ids")), "vectors")
    lists = fit(entries)
    shared = spark.sparkContext.broadcast(lists)  # LISTS centroids and their graph

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        held = np.zeros(len(index.centres), np.int64)
        for batch in batches:
            if batch.num_rows:
                held += np.bincount(index.distances(index.lift(_matrix(batch.column("x"))), index.centres).argmin(1), minlength=len(held))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held))), pa.array(held)], names=["list", "n"])

    homes = np.zeros(len(lists.centres), np.int64)
    for r in entries.select("x").mapInArrow(settle, "list long, n long").groupBy("list").agg(F.sum("n").alias("n")).collect():  # a row for each list
        homes[r["list"]] = r["n"]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = index.lift(_matrix(batch.column("x")))
            far = index.distances(x, index.centres)
            order = np.argsort(far, axis=1, kind="stable")[:, :COPIES]
            near = np.take_along_axis(far, order, 1)
            row, col = np.nonzero(near <= near[:, :1] * BORDER**2 + 1e-12)
            yield pa.RecordBatch.from_arrays([pa.array(order[row, col], pa.int64()), batch.column("first").take(pa.array(row)), batch.column("ids").take(pa.array(row)), batch.column("x").take(pa.array(row))], names=["list", "first", "ids", "x"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, where = [], []
            for i, x in enumerate(index.aim(_matrix(batch.column("x")))):
                found, far = index.closest(x, VISITS)
                near = int((far <= far[0] * PRUNE**2 + 1e-12).sum())
                if homes[found[:near]].sum() <= k:
                    if homes[found].sum() <= k:
                        found = ((index.centres - x) ** 2).sum(1).argsort(kind="stable")
                    near = max(near, int(np.searchsorted(np.cumsum(homes[found]), k + 1)) + 1)
                found = found[:near]
                rows += [i] * len(found)
                where += found.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), batch.column("query_id").take(pa.array(rows)), batch.column("x").take(pa.array(rows))], names=["list", "query_id", "q"])

    posted = entries.select("first", "ids", "x").mapInArrow(post, "list long, first long, ids array<long>, x array<double>")
    n_blocks = _blocks(int(homes.sum()), lists)
    posted = posted.withColumn("block", F.pmod(F.xxhash64("first"), F.lit(n_blocks)))
    queries = held.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "x").dropDuplicates(["query_id"])
    visits = queries.mapInArrow(visit, "list long, query_id long, q array<double>")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    visits = visits.withColumn("block", each(n_blocks))

    def score(keys: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            x, q = (_matrix(t.column(c).combine_chunks()) for t, c in ((left, "x"), (right, "q")))
            ids = left.column("ids").to_pylist()
            queries = right.column("query_id").to_pylist()
            for i, s in enumerate(_products(q, x)):
                most = k + 1
                while True:  # more than once only where entries repeat ids
                    best = np.argpartition(-s, most - 1)[:most] if len(s) > most else np.arange(len(s))
                    best = np.flatnonzero(s >= s[best].min() - 1e-9) if len(s) > most else best
                    if len(best) == len(s) or len({v for j in best for v in ids[j]} - {queries[i]}) >= k:
                        break
                    most *= 2
                for j in best:
                    exact = float(np.dot(q[i], x[j]))
                    for v in ids[j]:
                        if v != queries[i]:
                            for o, value in zip(out, (queries[i], v, exact), strict=True):
                                o.append(value)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    def ranked(visits: DataFrame) -> DataFrame:
        scored = posted.groupBy("list", "block").cogroup(visits.groupBy("list", "block")).applyInArrow(score, "query_id long, vec_id long, score double")
        scored = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = F.struct((-F.col("score")).alias("s"), "vec_id")
        return scored.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(order)), 1, k).alias("best"))  # bounded: about k + 1 entries of each visited block

    best = written(ranked(visits), "nearest")
    fed = best.where(F.size("best") >= k).select("query_id")
    short = queries.join(fed, "query_id", "left_anti")
    if not short.isEmpty():
        others = held.select("vec_id").distinct().limit(k + 1).count() - 1
        fed = best.where(F.size("best") >= min(k, others)).select("query_id")
        short = queries.join(fed, "query_id", "left_anti").select("query_id", F.col("x").alias("q"))
        all_lists = short.withColumn("list", each(len(lists.centres))).withColumn("block", each(n_blocks)).select("list", "query_id", "q", "block")
        best = best.join(fed, "query_id", "left_semi").unionByName(ranked(all_lists))
    out = best.select("query_id", F.posexplode("best").alias("pos", "b"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def _smallest(pairs: DataFrame, n: int) -> DataFrame:
    """key, ids: each key's n smallest ids, cut in salted groups first so that no key gathers all its ids."""
    from pyspark.sql import Window

    salted = Window.partitionBy("key", "salt").orderBy("vec_id")
    some = pairs.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= n)
    return some.groupBy("key").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, n).alias("ids"))


def _blocks(entries: int, lists: Lists) -> int:
    """Blocks that every list is dealt to, so that one block has about ``BLOCK`` entries."""
    return max(1, -(-entries * 2 // (len(lists.centres) * BLOCK)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))

"""Centroid clustering in exact integers, from dot products that are kept and updated.

Every vector keeps its dot product with each centroid, as an exact integer, in a written table. A round changes only
what a centroid's moved components change: the products grow by the vector's components times these changes, and the
squared distance is the vector's own square, minus twice the product, plus the centroid's square. The nearest centroid
follows anew from these. New centroids are exact sums by cluster, added up before any shuffle, so one cluster may hold
all rows. A round in which no centroid changes ends the work: all later ones would repeat it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
#: Components beyond this have squared distances that a 64-bit integer can't hold.
LARGEST = 1 << 27
EXACT = float(1 << 53)  # integers below are exact as doubles


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", *, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id and x, the components times 256, rounded down, of vectors of the right length without null, NaN, infinite
    or (over 2^27 after scaling) too large components."""
    scaled = F.transform(F.col(embedding).cast("array<double>"), lambda v: v * SCALE)
    fits = (F.size("x") == dimensions) & F.forall("x", lambda v: v.isNotNull() & (v >= -LARGEST) & (v < LARGEST))  # NaN is the largest of all
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), scaled.alias("x")).where(F.col("x").isNotNull() & fits).withColumn("x", F.transform("x", lambda v: F.floor(v).cast("int")))


def first_centroids(kept: DataFrame, number: int, seed: int) -> np.ndarray:
    """The vectors whose ``seed:vec_id`` has the smallest sha256, in that order; ties by components, null ids last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(order.asc_nulls_last(), "x").select("x").limit(number).collect()
    return np.array([r["x"] for r in rows], "i8")


def products(x: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Exact x times the transposed change, over the components that any centroid changes."""
    moved = np.flatnonzero(change.any(0))
    if not len(moved) or not len(x):
        return np.zeros((len(x), len(change)), "i8")
    x, change = x[:, moved], change[:, moved]
    if float(np.abs(x).max()) * float(np.abs(change).max()) * len(moved) < EXACT:
        return (x.astype(float) @ change.T.astype(float)).astype("i8")
    return x.astype("i8") @ change.T


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width).astype("i8", copy=False)


def assign(state: DataFrame, change: np.ndarray, squares: np.ndarray) -> DataFrame:
    """``state`` (vec_id, x and, after the first round, products) after a change of the centroids, with each vector's
    nearest centroid (ties: the smaller number) and squared distance. A written table."""
    known = "products" in state.columns

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), change.shape[1])
            dots = products(x, change) + (_matrix(batch.column("products"), len(squares)) if known else 0)
            far = (x * x).sum(1)[:, None] - 2 * dots + squares
            near = far.argmin(1) if len(far) else np.zeros(0, int)
            ends = pa.array(np.arange(0, len(x) * len(squares) + 1, len(squares), dtype="i4"))
            dots = pa.ListArray.from_arrays(ends, pa.array(dots.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), dots, pa.array(near.astype("i4")), pa.array(far[np.arange(len(far)), near])], names)

    names = ["vec_id", "x", "products", "cluster", "distance"]
    return written(state.mapInArrow(assigned, "vec_id long, x array<int>, products array<long>, cluster int, distance long"), "centroid_state")


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The clusters' componentwise sums over counts, rounded down; an empty cluster keeps its centroid."""
    sums = [F.sum(F.get("x", F.lit(d)).cast("long")).alias(f"s{d}") for d in range(centroids.shape[1])]
    out = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # at most a row a centroid
        out[row["cluster"]] = [row[f"s{d}"] // row["n"] for d in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, *, number: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 2, dimensions: int = DIMENSIONS, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector after ``rounds`` rounds, and the centroids.

    Vectors that are null, of another length, or with null, NaN, infinite or too large components take no part; null ids
    do, but are no first centroid before others. Repeated rows each have their row, with equal results. With fewer
    vectors than ``number`` all are first centroids; an empty table gives no rows and no centroids. Other columns are
    ignored. The driver holds the centroids and nothing else.
    """
    kept = integers(vectors, vec_id, embedding, dimensions=dimensions)
    centroids = first_centroids(kept, number, seed)
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), centroids
    state, change = kept, centroids
    for step in range(rounds + 1):
        if step and not change.any():
            break
        before, state = state, assign(state, change, (centroids * centroids).sum(1))
        if step:
            discard(before)
        if step < rounds:
            moved = means(state, centroids)
            change, centroids = moved - centroids, moved
    return state.select("vec_id", "cluster", "distance"), centroids


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with its cluster's and the whole inertia and its centroid's sha256."""
    spark = assigned.sparkSession
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r["cluster"]: int(r["inertia"]) for r in assigned.groupBy("cluster").agg(total.alias("inertia")).collect()}  # a row a centroid
    whole, said = sum(inertia.values()), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    fits = lambda n: n if n < 1 << 63 else None  # noqa: E731  a sum that a long can't hold is null
    facts = spark.createDataFrame([(c, fits(n), fits(whole), said[c]) for c, n in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(*cluster(table(spark, sf_dir, "embeddings")))

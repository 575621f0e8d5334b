"""Near-duplicate documents by min-max hashing, confirmed on whole shingle sets.

Every hash function gives two values of a signature, the least and the greatest hash of a set: both are unbiased for
the Jaccard similarity and their errors partly cancel, at half the evaluations. ``BANDS`` bands of ``ROWS`` values meet
in buckets; a pair with similarity 0.75 misses all of them with probability (1 - 0.75^6)^64 = 4e-6.

Equal sets are one class from the start. A bucket's head is the class that meets most others over all its buckets: of
near copies of one text, the text itself, if it is there. Members are compared with the head only. Those that this does
not join to its component can be similar to further members only if both sets have enough shingles that are not rare, or
if they share a rare one. So pairs meet by shingles that at most ``RARE`` of the compared sets have; where these don't
settle a pair, by those that few have (``SELDOM``, and a ``SHARE`` of the sets that a class meets); and only sets that
still can be similar meet in their buckets, in steps of sizes that fit. Sketches of a bit a value tell more of them
apart. Every bound is on the whole sets, so no pair of different components is left out, but for a sketch's odds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .graph import components
from .shingles import U, mix, shingle_sets, slices

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 64, 6
HASHES = BANDS * ROWS // 2
BROADCAST_IDS = 1_000_000  # of 8 bytes; a longer list of ids meets the sets in a shuffle
RARE, SELDOM, SHARE = 8, 128, 64  # sets that have a rare shingle; those that a seldom one has, and its share of the sets met
SET_BYTES = 6  # of a shingle's hash in stored sets: two sets of 400 share one by chance once in 10^9 pairs

_random = np.random.default_rng(30)
_A = _random.integers(1, 2**63, HASHES, dtype=np.uint64) | U(1)
_B = _random.integers(0, 2**63, HASHES, dtype=np.uint64)
_BAND = _random.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | U(1)


def bands(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket keys of a set, one a band, and its sketch: a bit of each value."""
    low, high = np.full(HASHES, 2**64 - 1, np.uint64), np.zeros(HASHES, np.uint64)
    for at in range(0, len(shingles), 512):
        h = shingles[at : at + 512, None] * _A + _B
        h ^= h >> U(32)
        low, high = np.minimum(low, h.min(0)), np.maximum(high, h.max(0))
    values = mix(np.concatenate([low, high]))
    keys = values.reshape(ROWS, BANDS).T  # a band mixes functions, and minima with maxima
    return mix((keys * _BAND).sum(1) + np.arange(BANDS, dtype=np.uint64)), np.packbits((values & U(1)).astype(bool)).view("<i8")


def most_differ(percent: int) -> int:
    """Sketch bits in which sets of the least similarity differ, and six standard deviations more: 10^-9 of pairs."""
    n, p = BANDS * ROWS, (1 - percent / 100) / 2
    return int(n * p + 6 * (n * p * (1 - p)) ** 0.5)


def pack_set(shingles: np.ndarray) -> bytes:
    return shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes()


def unpack_set(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // SET_BYTES, 8), np.uint8)
    out[:, :SET_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, SET_BYTES)
    return out.view("<u8").ravel()


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n (size of the set), key (128 bits that stand for the set), bands and packed set; of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), shingle)
                found = [bands(s) if len(s) else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for s in sets]
                keys = [mix(s).sum().tobytes() + mix(s * U(3) + U(1)).sum().tobytes() for s in sets]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "key": pa.array([k if len(s) else None for k, s in zip(keys, sets, strict=True)], pa.binary()),
                        "bands": pa.array([k.astype("i8") for k, _ in found], pa.list_(pa.int64())),
                        "sketch": pa.array([k for _, k in found], pa.list_(pa.int64())),
                        "shingles": pa.array([pack_set(s) for s in sets], pa.binary()),
                    }
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(sign, "doc_id long, n long, key binary, bands array<long>, sketch array<long>, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs (a, b) whose whole sets have 100 * intersection >= percent * union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                both = len(np.intersect1d(unpack_set(x), unpack_set(y), assume_unique=True))
                keep.append(100 * both >= percent * ((len(x) + len(y)) // SET_BYTES - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    wanted = written(pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    sets = sets.join(wanted, "class", "left_semi")  # few sets are ever compared, so the others aren't moved
    right = pairs.join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("right")), "b")
    both = right.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("left")), "a")
    return both.select("a", "b", "left", "right").mapInArrow(compare, "a long, b long").distinct()


def rare_shingles(sets: DataFrame) -> DataFrame:
    """class, shingle, df: a class's shingles that at most ``SELDOM`` of ``sets`` have, and how many have them."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, binaries in ((batch.column("class")[i : i + 1000], batch.column("shingles")[i : i + 1000]) for i in range(0, batch.num_rows, 1000)):
                found = [unpack_set(b.as_py()).view(np.int64) for b in binaries]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids.to_numpy(), [len(x) for x in found])), pa.array(np.concatenate(found))], names=["class", "shingle"])

    each = sets.mapInArrow(spread, "class long, shingle long")
    return each.withColumn("df", F.count("*").over(Window.partitionBy("shingle"))).where(F.col("df") <= SELDOM)


def size_step(n: Column) -> Column:
    """Sizes of sets in steps of a twentieth."""
    return F.floor(F.log(n) / math.log(1.05))


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``.

    component_id is the smallest doc_id that links reach, kept whether it is the row's own. Rows without words are
    linked with nothing. Rows that repeat an id each get a row. Rows without an id are linked with nothing and have
    neither component_id nor kept. Other columns are ignored; an empty table gives no rows.
    """
    rows = written(signatures(docs, shingle), "signatures")
    classes = rows.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("class"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    classes = written(classes, "classes")
    member = rows.select("doc_id", "n", "key").join(classes.select("key", "class"), "key", "left")
    member = written(member.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class")), "members")
    # an id that rows repeat with other texts stands for all their sets
    in_bands = classes.select("class", "n", F.explode("bands").alias("band"))
    shared = in_bands.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    buckets = written(in_bands.join(shared, "band"), "buckets")
    met = buckets.groupBy("class").agg(F.sum("m").alias("met"))
    buckets = written(buckets.drop("m").join(met, "class"), "scored_buckets")
    sets = rows.where("key is not null").select(F.col("doc_id").alias("class"), "shingles")

    def sizes_fit(a, b):
        return (100 * F.least(a, b) >= percent * F.greatest(a, b))

    head = F.max(F.struct("met", (-F.col("class")).alias("c"), "n")).alias("h")
    heads = buckets.groupBy("band").agg(head).select("band", (-F.col("h.c")).alias("head"), F.col("h.n").alias("n_head"))
    star = buckets.join(heads, "band").where((F.col("class") != F.col("head")) & sizes_fit(F.col("n"), F.col("n_head")))
    star = written(star.select(F.least("head", "class").alias("a"), F.greatest("head", "class").alias("b")).distinct(), "star")
    links = written(verified(star, sets, percent), "links")
    label = components(links).withColumnRenamed("node", "class")
    known = buckets.join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))
    at_head = known.join(heads, (known["band"] == heads["band"]) & (known["class"] == heads["head"])).select(known["band"], F.col("component").alias("done"))
    known = written(known.join(at_head, "band").withColumn("left_out", F.col("component") != F.col("done")).drop("done"), "labelled_buckets")
    open_bands = known.where("left_out").select("band").distinct()
    known = known.join(open_bands, "band")
    compared = written(known.select("class").distinct(), "compared")
    compared_sets = sets.join(compared, "class", "left_semi")
    found = written(rare_shingles(compared_sets), "rare_shingles")
    several = compared_sets.groupBy("class").agg(F.count("*").alias("k")).where("k > 1").select("class", F.lit(True).alias("several"))
    one = known.groupBy("class").agg(F.max("left_out").alias("open"), *[F.any_value(c).alias(c) for c in ("n", "component", "met")])
    limit = F.when(F.col("open"), F.greatest(F.lit(RARE), F.least(F.lit(SELDOM), F.floor(F.col("met") / SHARE)))).otherwise(RARE).alias("limit")
    one = written(one.select("class", "n", "component", "open", limit).join(several, "class", "left"), "open_classes")
    count = lambda c: F.count_if(F.col("df") <= c)
    rare = found.join(one.select("class", "limit", "several"), "class").groupBy("class").agg(*[F.when(F.any_value("several"), 0).otherwise(count(c)).alias(a) for c, a in ((F.lit(RARE), "rare"), (F.col("limit"), "seldom"))])
    # of a class of several sets every shingle counts as common
    one = one.join(rare, "class", "left").join(classes.select("class", "sketch").dropDuplicates(["class"]), "class")
    one = one.select("class", "n", "component", "open", "limit", F.coalesce("several", F.lit(False)).alias("several"), "sketch", (F.col("n") - F.coalesce("rare", F.lit(0))).alias("common"), (F.col("n") - F.coalesce("seldom", F.lit(0))).alias("often"))
    one = written(one, "counted_classes")

    of = lambda df, x, *on: df.select(*on, *[F.col(c).alias(c + x) for c in df.columns if c not in on])
    size = F.col("n_x") + F.col("n_y")
    enough = lambda both: (100 + percent) * both >= percent * size
    apart = F.col("component_x") != F.col("component_y")
    differ = sum((F.bit_count(F.col("sketch_x")[i].bitwiseXOR(F.col("sketch_y")[i])) for i in range(BANDS * ROWS // 64)), F.lit(0))
    alike = sizes_fit(F.col("n_x"), F.col("n_y")) & (differ <= most_differ(percent))
    unsure = F.col("several_x") | F.col("several_y")
    least = lambda c: F.least(c + "_x", c + "_y")
    ordered = (F.least("class_x", "class_y").alias("a"), F.greatest("class_x", "class_y").alias("b"))

    # without a rare shingle in both, two sets share what is common in either at most
    short = one.select("class", "component", "open", "n", "common", "often", "limit", "several")
    by_rare = found.where(F.col("df").between(2, RARE)).drop("df").join(short.select("class", "component", "open"), "class")
    met_rare = of(by_rare.where("open"), "_x", "shingle").join(of(by_rare, "_y", "shingle"), "shingle").where(apart & (~F.col("open_y") | (F.col("class_x") < F.col("class_y"))))
    met_rare = met_rare.groupBy("class_x", "class_y").agg(F.count("*").alias("s")).join(of(one, "_x"), "class_x").join(of(one, "_y"), "class_y")
    met_rare = met_rare.where(unsure | (alike & enough(least("common") + F.col("s")))).select(*ordered)
    # and so for shingles that few of the sets have that one of the two meets
    seldom = found.where("df > 1").join(short, "class")
    seldom_x = seldom.where(F.col("open") & ~F.col("several") & (F.col("often") < F.col("common")) & (F.col("df") <= F.col("limit"))).drop("df", "limit", "open")
    met_seldom = of(seldom_x, "_x", "shingle").join(of(seldom.drop("df", "limit", "open", "often"), "_y", "shingle"), "shingle").where(apart & ~enough(F.col("often_x")) & (unsure | (sizes_fit(F.col("n_x"), F.col("n_y")) & enough(least("common")))))
    met_seldom = met_seldom.groupBy("class_x", "class_y", "n_x", "n_y", "often_x", "several_y").agg(F.count("*").alias("s")).where(F.col("several_y") | enough(F.col("often_x") + F.col("s"))).select(*ordered)
    # all others meet in their bands, in steps of sizes that can be similar
    known = known.select("band", "class", "n", "left_out").join(one.select("class", "component", "sketch", "often", "several"), "class")
    known = known.withColumn("often", F.when(F.col("several"), F.col("n")).otherwise(F.col("often"))).drop("several")
    known = written(known, "open_buckets")
    top = F.least(F.floor(F.col("n") * 100 / percent), F.floor(F.col("often") * (100 + percent) / percent) - F.col("n"))
    low = F.ceil(F.col("n") * percent / 100)
    left = known.where(F.col("left_out") & (low <= top)).withColumn("step", F.explode(F.sequence(size_step(low), size_step(top))))
    every = known.withColumn("step", size_step(F.col("n")))
    once = ~F.col("left_out_y") | (F.col("class_x") < F.col("class_y"))
    met_often = of(left, "_x", "band", "step").join(of(every, "_y", "band", "step"), ["band", "step"]).where(apart & once & alike & enough(least("often"))).select(*ordered)
    more = written(met_rare.unionByName(met_seldom).unionByName(met_often).distinct(), "rest")
    links = written(links.unionByName(verified(more, sets, percent)), "links")
    final = components(links)
    out = member.join(final.withColumnRenamed("node", "class"), "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps, with all their columns; of rows that repeat an id, one. Rows without an id stay."""
    ids = near_duplicates(docs, **options).where("kept").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

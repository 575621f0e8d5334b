"""Best-fit packing of tokenised documents into sequences of fixed capacity, planned on the lengths' histogram.

The plan needs only how many pieces have each length, at most ``capacity`` numbers, so the driver holds a bounded state
at any scale. Large-item matching: pieces over one third of the capacity meet at most twice in a sequence, and are
paired greedily, the longest with the longest that still fits; smaller pieces, longest first, go to the sequence whose
gap they fit best. Equal lengths are planned together: one step of the plan places as many copies as a kind of
sequence has room for. Each piece then finds its place by its number among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .tokens import default_vocabulary, encoder, in_slices

CAPACITY, END_ID = 1024, 2
PIECES = "part long, nth long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of sequences as (lengths in order, number of sequences), for so many pieces of each length."""
    left = {n: c for n, c in histogram.items() if c > 0}
    kinds: Counter[tuple[int, ...]] = Counter()
    large = sorted(n for n in left if 3 * n > capacity)
    while large:  # the longest takes the longest that fits; lengths over half can't meet each other
        a = large[-1]
        fits = [n for n in large if n <= capacity - a and (n != a or left[a] > 1)]
        if not fits:
            kinds[(a,)] += left.pop(a)
        else:
            b = fits[-1]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            kinds[(a, b)] += n
            for x in (a, b):
                left[x] -= n
                if not left[x]:
                    del left[x]
        large = [n for n in large if n in left]
    by_gap: dict[int, Counter[tuple[int, ...]]] = {}
    gaps: list[int] = []

    def add(items: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(items)
        if gap not in by_gap:
            by_gap[gap] = Counter()
            insort(gaps, gap)
        by_gap[gap][items] += n

    for items, n in kinds.items():
        add(items, n)
    for size in sorted(left, reverse=True):
        todo = left[size]
        while todo:
            at = bisect_left(gaps, size)
            if at == len(gaps):
                each = min(capacity // size, todo)  # new sequences, full of this length
                add((size,) * each, todo // each)
                todo -= todo // each * each
                continue
            gap = gaps[at]
            items, n = next(iter(by_gap[gap].items()))
            each = min(gap // size, todo)
            n = min(n, todo // each)
            by_gap[gap][items] -= n
            if not by_gap[gap][items]:
                del by_gap[gap][items]
                if not by_gap[gap]:
                    del by_gap[gap]
                    gaps.pop(at)
            add((*items, *(size,) * each), n)
            todo -= n * each
    return sorted((i, n) for c in by_gap.values() for i, n in c.items())


def pieces(docs: DataFrame, vocabulary: str, *, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each document's ids, with the end id, as one piece or, if longer than the capacity, as several.

    The first piece of a long document takes the remainder, so only it is short. ``ids`` holds little-endian unsigned
    16-bit ids where the vocabulary fits, else 32-bit. Null texts count as empty; null ids and repeated rows are kept.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        wide = "<u2" if encode.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        part, nth = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            texts, docs = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for now in in_slices(texts):
                rows = []
                for doc, found in zip(docs[now], encode(texts[now]), strict=True):
                    found = np.append(found, np.uint32(end_id))
                    at, end = 0, len(found) % capacity or min(capacity, len(found))
                    k = 0
                    while at < len(found):
                        ids = found[at:end]
                        rows.append((part, nth[len(ids)], doc, k, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(wide).tobytes()))
                        nth[len(ids)] += 1
                        at, end, k = end, end + capacity, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "nth", "doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, vocabulary: str, *, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Places of all pieces: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    Sequences are numbered from 0 and gapless inside. The pieces are written once, so a lost executor costs no second
    numbering. An empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, vocabulary, capacity=capacity, end_id=end_id), "pieces")
    # a row for each task and length: the numbers inside a task go on where the task before ended
    counts = cut.groupBy("length", "part").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = written(counts, "piece_counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots, first, taken = [], 0, Counter()
    for items, n in plan(histogram, capacity):
        at = 0
        each = Counter(items)
        seen: Counter[int] = Counter()
        for size in items:
            slots.append((size, taken[size], taken[size] + each[size] * n, each[size], seen[size], at, first))
            seen[size] += 1
            at += size
        for size, k in each.items():
            taken[size] += k * n
        first += n
    # pieces `low`..`high` of a length sit in sequences first, first + 1, ..., `each` of them in one
    schema = "length long, low long, high long, `each` long, k long, offset long, first long"
    slots_df = spark.createDataFrame(slots, schema).groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "each", "k", "offset", "first"))).alias("slots"))
    number = F.col("base") + F.col("nth")
    placed = cut.join(F.broadcast(counts.select("length", "part", "base")), ["length", "part"]) if counts.count() <= 200_000 else cut.join(counts.select("length", "part", "base"), ["length", "part"])
    placed = placed.withColumn("number", number).join(F.broadcast(slots_df), "length")
    inside = F.filter("slots", lambda s: (s["low"] <= F.col("number")) & (F.col("number") < s["high"]) & ((F.col("number") - s["low"]) % s["each"] == s["k"]))
    placed = placed.withColumn("slot", inside[0])
    sequence = F.col("slot.first") + F.floor((F.col("number") - F.col("slot.low")) / F.col("slot.each"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", sequence.cast("long").alias("sequence_id"), F.col("slot.offset").alias("offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_vocabulary()).drop("ids")

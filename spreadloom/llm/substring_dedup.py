"""Repeated byte strings by bucket-pointer refinement over sampled suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Sorting all suffixes is not needed
to tell: each string's place is represented by the one of its q-grams with the least hash, so equal strings have equal
representatives at equal places. Consecutive strings with the same representative form a segment.

1. Segments fall into buckets by their representative's q-gram; buckets of one drop out.
2. A bucket is refined by sorting on the identifiers of its segments' whole contents: equal segments are repeated as
   a whole.
3. Where a bucket has different segments, one copy of each is refined again into its single strings, whose buckets
   use those of their two halves: the q-gram at the string's start and the one q bytes later.

Every step is a partitioned sort read as a stream, in memory independent of the size of a bucket. Equal segments that
one task meets in its texts go to their bucket once, so a very common passage sends it a row a task, not a row a copy. The texts are
written once, bucketed by row, so that later steps join their findings to them without moving them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, table
from .shingles import U, _power, mix

LENGTH = 200
PIECE = 2_000_000  # bytes looked at together; longer texts are cut with an overlap
_random = np.random.default_rng(60)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_LOW = U((1 << 24) - 1)
FOUND = "rid long, at long, n int"


class Hashes:
    """Hashes of all substrings of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))

    def grams(self, q: int) -> np.ndarray:
        n = max(0, len(self.sums) - q)
        return mix((self.sums[q : q + n] - self.sums[:n]) * self.down[:n] + U(q))


def segments(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first string, number of strings, bucket, content) of each segment of bytes that hold texts up to ``ends``."""
    q, n = length // 2, len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    hashes = Hashes(data)
    grams = hashes.grams(q)
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)  # of equal hashes the first place is less
    wide, size = length - q + 1, 1
    while size * 2 <= wide:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if size < wide:
        least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
    at = (least[:n] & _LOW).astype(np.int64)
    inside = np.ones(n + 1, bool)
    for end in ends:  # strings that cross texts
        inside[max(0, end - length + 1) : end] = False
    inside[n:] = False
    begin = np.flatnonzero(inside[:n] & np.concatenate([[True], (at[1:] != at[:-1]) | ~inside[: n - 1]]))
    close = np.flatnonzero(inside[:n] & np.concatenate([(at[1:] != at[:-1]) | ~inside[1:n], [True]]))
    return begin, close - begin + 1, grams[at[begin]], hashes.of(begin, close + length)


def pieces(batch: pa.RecordBatch, length: int) -> Iterator[tuple[list[int], list[int], list[int], np.ndarray]]:
    """Rows' ids, their pieces' starts within the row and ends within the joint bytes, and these bytes."""
    ids, starts, ends, held, size = [], [], [], [], 0
    for rid, text in zip(batch.column("rid").to_pylist(), batch.column("data"), strict=True):
        data = np.frombuffer(text.as_buffer() if text.is_valid else b"", np.uint8)
        for at in range(0, max(1, len(data) - length + 1), PIECE):
            part = data[at : at + PIECE + length - 1]
            if size + len(part) > PIECE + length and size:
                yield ids, starts, ends, np.concatenate(held)
                ids, starts, ends, held, size = [], [], [], [], 0
            size += len(part)
            ids.append(rid)
            starts.append(at)
            ends.append(size)
            held.append(part)
    if size:
        yield ids, starts, ends, np.concatenate(held)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def bucketed(docs: DataFrame) -> DataFrame:
    """rid (unique), doc_id and the text's bytes as a table bucketed by rid."""
    spark = docs.sparkSession
    name = f"substring_texts_{uuid.uuid4().hex}"
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("data"))
    rows.write.option("compression", "zstd").bucketBy(shuffle_partitions(spark), "rid").saveAsTable(name)
    return spark.table(name)


def find_segments(texts: DataFrame, length: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, starts, ends, data in pieces(batch, length):
                begin, n, bucket, content = segments(data, np.array(ends), length)
                row = np.searchsorted(ends, begin, "right")
                first = np.array([0, *ends[:-1]])
                place = (begin - first[row] + np.array(starts)[row]) * 256 + n
                rid = np.array(ids, np.int64)[row]
                # equal segments of these texts are known to be repeated: one of them goes to the bucket for all
                order = np.lexsort((content, bucket))
                again = np.zeros(len(order), bool)
                again[1:] = (bucket[order][1:] == bucket[order][:-1]) & (content[order][1:] == content[order][:-1])
                known = np.zeros(len(order), bool)
                known[order] = again | np.append(again[1:], False)
                bucket[order[again]] = mix(rid[order[again]].astype(np.uint64) * U(_BYTE[0]) + place[order[again]].astype(np.uint64))
                yield pa.RecordBatch.from_pydict({"bucket": _signed(bucket), "content": _signed(content), "rid": pa.array(rid), "place": pa.array(place, pa.int64()), "known": pa.array(known)})

    return texts.select("rid", "data").mapInArrow(find, "bucket long, content long, rid long, place long, known boolean")


def refine(found: DataFrame) -> DataFrame:
    """rid, place, repeated, refine_on: of segments that share a bucket, whether another is equal and whether this copy
    stands for its content in the next step."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, same_b, same_c, opened, reps = None, False, False, None, 0  # the last row, how it relates to the one before; its bucket's first row and number of contents
        for batch in _with_end(batches):
            if batch is None:
                if tail is not None:
                    cols = [np.array([x]) for x in tail]
                    more = False
                else:
                    break
            else:
                now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "content", "rid", "place", "known")]
                if not len(now[0]):
                    continue
                cols = [np.concatenate([[t], x]) for t, x in zip(tail, now, strict=True)] if tail is not None else now
                more = True
            bucket, content, rid, place, known = cols
            known = known.astype(bool)
            m = len(bucket)
            prev_b = np.concatenate([[same_b], bucket[1:] == bucket[:-1]])
            prev_c = np.concatenate([[same_c], (bucket[1:] == bucket[:-1]) & (content[1:] == content[:-1])])
            next_b, next_c = np.append(prev_b[1:], False), np.append(prev_c[1:], False)
            k = m - 1 if more else m  # the last row waits for its successor
            rep = ~prev_c
            repeated = (prev_c | next_c | known)[:k]
            shares = (prev_b | next_b | known)[:k]
            on = (rep & prev_b)[:k]
            out = [(rid[:k][shares], place[:k][shares], repeated[shares], on[shares])]
            head = np.maximum.accumulate(np.where(~prev_b, np.arange(m), -1))[:k]
            count = np.cumsum(rep[:k])
            within = count - np.where(head >= 0, count[head] - 1, -reps if tail is not None else 0)
            second = np.flatnonzero(on & (within == 2))
            inner = second[head[second] >= 0]
            out.append((rid[head[inner]], place[head[inner]], np.zeros(len(inner), bool), np.ones(len(inner), bool)))
            if opened is not None and len(second) > len(inner):
                out.append((np.array([opened[0]]), np.array([opened[1]]), np.array([False]), np.array([True])))
            if k:
                if head[k - 1] >= 0:
                    opened = (rid[head[k - 1]], place[head[k - 1]])
                reps = int(within[k - 1])
            if more:
                tail, same_b, same_c = [x[-1] for x in cols], bool(prev_b[-1]), bool(prev_c[-1])
            rows = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2]), pa.array(rows[3])], names=["rid", "place", "repeated", "refine_on"])
            if not more:
                break

    parts = shuffle_partitions(found.sparkSession)
    return found.repartition(parts, "bucket").sortWithinPartitions("bucket", "content").mapInArrow(stream, "rid long, place long, repeated boolean, refine_on boolean")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def single_strings(texts: DataFrame, marked: DataFrame, length: int) -> DataFrame:
    """half, other, rid, at: the strings of the segments to be refined, by the buckets of their halves."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = length // 2
        for batch in batches:
            halves, others, rids, ats = [], [], [], []
            for rid, text, places in zip(batch.column("rid").to_pylist(), batch.column("data"), batch.column("places"), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                place = np.asarray(places.values)
                for at, n in zip(place // 256, place % 256, strict=True):
                    hashes = Hashes(data[at : at + n + length - 1]).grams(q)
                    halves.append(hashes[:n])
                    others.append(hashes[length - q : length - q + n])
                    rids.append(np.full(n, rid))
                    ats.append(np.arange(at, at + n))
            if halves:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(halves)), _signed(np.concatenate(others)), pa.array(np.concatenate(rids), pa.int64()), pa.array(np.concatenate(ats), pa.int64())], names=["half", "other", "rid", "at"])

    wanted = marked.where("refine_on").groupBy("rid").agg(F.collect_set("place").alias("places"))  # of one text
    return texts.join(wanted, "rid").select("rid", "data", "places").mapInArrow(strings, "half long, other long, rid long, at long")


def repeated_strings(strings: DataFrame) -> DataFrame:
    """rid, at of strings that have an equal one."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, same = None, False
        for batch in _with_end(batches):
            if batch is None:
                cols = [np.array([x]) for x in tail] if tail is not None else None
            else:
                now = [batch.column(c).to_numpy() for c in ("half", "other", "rid", "at")]
                if not len(now[0]):
                    continue
                cols = [np.concatenate([[t], x]) for t, x in zip(tail, now, strict=True)] if tail is not None else now
            if cols is None:
                return
            half, other, rid, at = cols
            before = np.concatenate([[same], (half[1:] == half[:-1]) & (other[1:] == other[:-1])])
            keep = before | np.append(before[1:], False)
            if batch is not None:
                tail, same, keep = [x[-1] for x in cols], bool(before[-1]), keep[:-1]
            k = len(keep)
            yield pa.RecordBatch.from_arrays([pa.array(rid[:k][keep], pa.int64()), pa.array(at[:k][keep], pa.int64())], names=["rid", "at"])

    parts = shuffle_partitions(strings.sparkSession)
    return strings.repartition(parts, "half").sortWithinPartitions("half", "other").mapInArrow(stream, "rid long, at long")


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: long, end: long>>, text binary"


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (begin, end) of every row; with_text adds the bytes that stay.

    Null and empty texts have no bytes. Rows that repeat an id, and rows without one, are documents of their own, so a
    repeated row of at least ``length`` bytes goes wholly. Other columns are ignored; an empty table gives no rows.
    """
    from .common import written

    texts = bucketed(docs)
    marked = written(refine(find_segments(texts, length)), "segments")
    strings = repeated_strings(single_strings(texts, marked, length))
    whole = marked.where("repeated").select("rid", F.floor(F.col("place") / 256).alias("at"), (F.col("place") % 256).alias("n"))
    found = whole.unionByName(strings.select("rid", "at", F.lit(1).cast("long").alias("n")))
    found = found.groupBy("rid").agg(F.collect_list(F.struct("at", "n")).alias("found"))  # at most a text's strings

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text"]
        for batch in batches:
            rows = []
            for doc, text, places in zip(batch.column("doc_id").to_pylist(), batch.column("data"), batch.column("found"), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                change = np.zeros(len(data) + 1, np.int32)
                if places.is_valid:
                    values = places.values
                    at, n = np.asarray(values.field("at")), np.asarray(values.field("n"))
                    np.add.at(change, at, 1)
                    np.add.at(change, at + n + length - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                kept = data[~gone].tobytes()
                spans = [{"begin": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                rows.append((doc, len(data), int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept if with_text else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    out = texts.join(found, "rid", "left").select("doc_id", "data", "found").mapInArrow(remove, KEPT)
    return out if with_text else out.drop("text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")

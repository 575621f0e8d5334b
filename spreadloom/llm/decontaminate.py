"""Benchmark passages in documents, found in a latent semantic space and confirmed word by word.

1. Documents become sequences of word numbers; only words of the benchmark have one, as no other word can add to a
   similarity with it. Later steps read these sequences, not the texts.
2. A randomised SVD of the TF-IDF matrix of all passages (``PASSAGE`` words) together with the benchmark items, which
   weigh as much as all passages. Each task adds its passages to a sketch of ``SKETCH`` rows, a passage to ``SIGNS`` of
   them with random signs, and counts words by passage in the same pass; the sum of the sketches has the matrix's
   leading directions, which an SVD of it and the items gives.
3. Items are searched in pieces of at most ``PASSAGE`` words. Windows of ``PASSAGE`` words at every half passage are
   projected, and for items of under ``SHORT`` words also windows of one to two times the item's length. A window and a
   piece are candidates if their cosine and the share of the piece that the window covers are large enough.
4. The longest common subsequence of a candidate's words with the words around the window decides: a leak has at least
   ``SURE`` of the item's words in order; a paraphrase at least ``LIKELY`` and also the item's answer. A benchmark has
   one text an item, question first, so its last words stand for the answer. Items of fewer than ``LEAST_WORDS`` words
   have too few for a subsequence to mean something and must stand word for word.

The benchmark is taken in blocks of about ``ITEMS`` pieces, so what the driver and the tasks hold is bounded by a block
and by the words of ``SHARED`` blocks, which share one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, shuffle_partitions, table, written
from .shingles import lower_bytes, slices, word_hashes

PASSAGE, ITEMS, EXTRA_RANK = 64, 256, 16
SHARED = 64  # blocks of ITEMS pieces that one pass over the texts encodes for; about SHARED * ITEMS * PASSAGE words at most
SKETCH, SIGNS = 256, 8
COSINE, COVERAGE = 0.3, 0.35
MAX_DF = 0.1  # words in a larger share of passages have no weight, unless an item would keep fewer than LEAST_WORDS
SURE, LIKELY, ANSWER_WORDS, ANSWER_SHARE = 0.7, 0.5, 6, 0.8
SHORT = PASSAGE * (COSINE / LIKELY) ** 2  # words; the likely share of fewer is under COSINE in a passage full of benchmark words
LEAST_WORDS = 5
PAIRS = "doc_id long, item_id long, cosine double, lcs double, answer_found boolean"
SPACE = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])


def sequences(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id and words (unsigned 32-bit numbers, 0: none of the vocabulary's) of texts that have a word of it."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, at = word_hashes(*lower_bytes(part.column("text")), SPACE)
                place = np.searchsorted(vocabulary, words)
                found = np.where(vocabulary[np.minimum(place, len(vocabulary) - 1)] == words, place + 1, 0).astype("<u4")
                rows = [found[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                keep = [i for i, x in enumerate(rows) if x.any()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(keep, pa.int64())), pa.array([rows[i].tobytes() for i in keep], pa.binary())], names=["doc_id", "words"])

    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(encode, "doc_id long, words binary")


def narrowed(encoded: DataFrame, vocabulary: np.ndarray, part: np.ndarray) -> DataFrame:
    """``encoded`` with the numbers of ``part``, some words of ``vocabulary``, and without the texts that have none."""
    if len(part) == len(vocabulary):
        return encoded
    number = np.zeros(len(vocabulary) + 1, "<u4")
    number[np.searchsorted(vocabulary, part) + 1] = np.arange(1, len(part) + 1)
    shared = encoded.sparkSession.sparkContext.broadcast(number)  # of the words of SHARED blocks

    def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value[np.frombuffer(x.as_buffer(), "<u4")] for x in batch.column("words")]
            keep = [i for i, x in enumerate(rows) if x.any()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array([rows[i].tobytes() for i in keep], pa.binary())], names=["doc_id", "words"])

    return encoded.mapInArrow(renumber, "doc_id long, words binary")


def _rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers above 0 and the passage (of ``size`` words, numbered from 0) that each is in, for a few texts at a time."""
    for batch in batches:
        held, blocks, n, total = [], [], 0, 0
        for words in batch.column("words"):
            x = np.frombuffer(words.as_buffer(), "<u4")
            at = np.flatnonzero(x)
            held.append(x[at])
            blocks.append(at // size + n)
            n += -(-len(x) // size)
            total += len(at)
            if total > 200_000:
                yield np.concatenate(held), np.concatenate(blocks)
                held, blocks, n, total = [], [], 0, 0
        if held:
            yield np.concatenate(held), np.concatenate(blocks)


def sketch(held: DataFrame, d: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each number the passages that have it (at 0: how many passages have any), and its column of the sketch of
    the passages' matrix of counts."""

    def add_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, out = np.zeros(d + 1, np.int64), np.zeros((d + 1) * SKETCH, np.float32)
        rng = np.random.default_rng(TaskContext.get().partitionId())  # of a written table, so a repeated task repeats it
        for words, blocks in _rows(batches, size):
            pairs, times = np.unique(blocks * (d + 1) + words, return_counts=True)
            block, word = np.divmod(pairs, d + 1)
            _, row = np.unique(block, return_inverse=True)
            found += np.bincount(word, minlength=d + 1)
            found[0] += row[-1] + 1
            place, sign = rng.integers(0, SKETCH, (SIGNS, row[-1] + 1)), rng.integers(0, 2, (SIGNS, row[-1] + 1)) * 2 - 1
            for p, q in zip(place, sign, strict=True):
                np.add.at(out, word * SKETCH + p[row], (times * q[row]).astype(np.float32))
        some = np.flatnonzero(found)
        if len(some):
            out = out.reshape(d + 1, SKETCH)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some]), pa.array([x.astype("<f4").tobytes() for x in out[some]], pa.binary())], names=["word", "n", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = {}, {}
        for batch in batches:
            for w, n, x in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "row")), strict=True):
                counts[w] = counts.get(w, 0) + n
                sums[w] = sums.get(w, 0.0) + np.frombuffer(x, "<f4").astype(float)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(list(counts.values())), pa.array([x.astype("<f4").tobytes() for x in sums.values()], pa.binary())], names=["word", "n", "row"])

    schema = "word long, n long, row binary"
    parts = held.mapInArrow(add_passages, schema).repartition(min(d, shuffle_partitions(held.sparkSession)), "word").mapInArrow(add, schema)
    counts, out = np.zeros(d + 1, np.int64), np.zeros((d + 1, SKETCH), np.float32)
    for r in parts.collect():  # a row for each word of a block of the benchmark
        counts[r["word"]], out[r["word"]] = r["n"], np.frombuffer(r["row"], "<f4")
    return counts, out


def latent_basis(weighted: np.ndarray, unit: np.ndarray, rank: int) -> np.ndarray:
    """The leading directions of the passages' sketch (words by rows) and of the items, each as heavy as all passages."""
    scale = np.linalg.norm(weighted)
    held = np.vstack([weighted.T / scale if scale else weighted.T, unit])
    return np.linalg.svd(held, full_matrices=False)[2][:rank].T


def common_length(item: np.ndarray, masks: dict[int, int], region: np.ndarray) -> int:
    """Length of the longest common subsequence, all of the item's places at once as bits."""
    state = full = (1 << len(item)) - 1
    for w in region.tolist():
        if w in masks:
            u = state & masks[w]
            state = (state + u) | (state - u)
    return len(item) - (state & full).bit_count()


def place_masks(item: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def pieces_of(n: int, size: int) -> int:
    return max(1, -(-n // size))


def _block(texts: DataFrame, known: np.ndarray, wanted: dict[tuple[int, str], set[int]], *, passage: int) -> DataFrame:
    """Matches of items, id and text, found by those of their pieces that ``wanted`` numbers, in texts encoded with the
    words ``known``."""
    spark, items = texts.sparkSession, sorted(wanted)
    words, at = word_hashes(*lower_bytes(pa.array([t for _, t in items], pa.string())), SPACE)
    vocabulary = np.unique(words)
    numbers = np.searchsorted(vocabulary, words) + 1
    held, pieces = [], []  # a piece: its item's place in held, and its first word; the last one ends with the item
    exact: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item, a, b in zip(items, at[:-1], at[1:], strict=True):
        if 0 < b - a < LEAST_WORDS:
            exact.setdefault(int(numbers[a]), []).append((item[0], numbers[a:b]))
            continue
        found = [k for k in sorted(wanted[item]) if k < pieces_of(b - a, passage)] if b > a else []
        pieces += [(len(held), max(0, min(k * passage, b - a - passage))) for k in found]
        held += [(item[0], numbers[a:b])] if found else []
    if not len(vocabulary):
        return spark.createDataFrame([], PAIRS)
    encoded = narrowed(texts, known, vocabulary)
    if not held:
        return encoded.mapInArrow(lambda batches: _verbatim(batches, exact), PAIRS)
    d = len(vocabulary)
    counts, weighted = sketch(encoded, d, passage)
    n = int(counts[0])
    idf = np.log((1 + n) / (1 + counts)) + 1
    common = counts > MAX_DF * max(1, n)
    cut = [held[j][1][a : a + passage] for j, a in pieces]
    for x in cut:
        if (~common[x]).sum() < LEAST_WORDS:
            common[x] = False
    idf[common] = idf[0] = 0.0
    rows = np.zeros((len(cut), d + 1))
    for r, x in enumerate(cut):
        np.add.at(rows[r], x, 1.0)
    rows *= idf
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    basis = latent_basis(weighted * idf[:, None], unit, min(d, len(cut) + EXTRA_RANK))
    latent = rows @ basis
    lengths = np.linalg.norm(latent, axis=1)
    scales = {passage // 2: np.arange(len(cut))}  # half a window's words, and the pieces it is compared with
    for r, x in enumerate(cut):
        half = 1 << max(1, (len(x) - 1).bit_length() - 1)
        if len(x) < SHORT and half < passage // 2:
            scales[half] = np.append(scales.get(half, np.zeros(0, int)), r)
    # what a word in a window adds to the window's product with each piece's direction in the latent space
    adds = (idf[:, None] * (basis @ (latent / lengths[:, None]).T)).astype(np.float32)
    shared = spark.sparkContext.broadcast((idf, adds, lengths, held, pieces, scales))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, adds, lengths, held, pieces, scales = shared.value
        masks = [place_masks(x) for _, x in held]
        for batch in batches:
            out = []
            for doc, binary in zip(batch.column("doc_id").to_pylist(), batch.column("words"), strict=True):
                x = np.frombuffer(binary.as_buffer(), "<u4").astype(np.int64)
                at = np.flatnonzero(x)
                at = at[idf[x[at]] > 0]
                if not len(at):
                    continue
                w, value = x[at], idf[x[at]].astype(np.float32)
                best: dict[int, tuple[float, float, bool]] = {}
                seen: set[tuple[int, int]] = set()
                for half, some in scales.items():
                    block = at // half
                    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                    n = len(x) // half + 1
                    weight = np.zeros(n + 1)
                    weight[block[starts]] = np.add.reduceat(value, starts)
                    # a projection is no longer than its words' weights together
                    windows = np.flatnonzero(weight[:-1] + weight[1:] >= COVERAGE * lengths[some].min())
                    if not len(windows):
                        continue
                    sums, norms = np.zeros((n + 1, len(some)), np.float32), np.zeros(n + 1)
                    norms[block[starts]] = np.add.reduceat(value * value, starts)
                    sums[block[starts]] = np.add.reduceat(adds[w] if len(some) == adds.shape[1] else adds[np.ix_(w, some)], starts, axis=0)
                    dots = sums[windows] + sums[windows + 1]
                    size = np.sqrt(norms[windows] + norms[windows + 1])[:, None] + 1e-9
                    for row, col in zip(*np.nonzero((dots >= COSINE * size) & (dots >= COVERAGE * lengths[some])), strict=True):
                        i, (j, first) = int(windows[row]), pieces[some[col]]
                        item = held[j][1]
                        m = len(item)
                        if m <= 2 * half:
                            region = x[max(0, i * half - m) : (i + 2) * half + m]
                        else:  # pieces that agree on the item's place, to an eighth of its length, share a look at all of it
                            step = max(half, m // 8)
                            place = (i * half - first) // step
                            if (j, place) in seen:
                                continue
                            seen.add((j, place))
                            region = x[max(0, place * step - m // 2 - half) : max(0, (place + 1) * step + m + m // 2 + half)]
                        share = common_length(item, masks[j], region) / m
                        if share >= LIKELY and share > best.get(j, (0.0,))[0]:
                            answer = item[-ANSWER_WORDS:]
                            found = common_length(answer, place_masks(answer), region) >= ANSWER_SHARE * len(answer)
                            best[j] = (share, min(1.0, float(dots[row, col] / size[row, 0])), found)
                out += [(doc, held[j][0], c, s, f) for j, (s, c, f) in best.items() if s >= SURE or f]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()), strict=True)], names=["doc_id", "item_id", "cosine", "lcs", "answer_found"])

    found = encoded.mapInArrow(search, PAIRS)
    return found.unionByName(encoded.mapInArrow(lambda batches: _verbatim(batches, exact), PAIRS)) if exact else found


def _verbatim(batches: Iterator[pa.RecordBatch], exact: dict[int, list[tuple[int, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """Matches of a few words one after another, looked for at each place of their first one."""
    firsts = np.array(sorted(exact))
    for batch in batches:
        out = set()
        for doc, binary in zip(batch.column("doc_id").to_pylist(), batch.column("words"), strict=True):
            x = np.frombuffer(binary.as_buffer(), "<u4")
            for at in np.flatnonzero(np.isin(x, firsts)).tolist():
                out |= {(doc, i) for i, item in exact[int(x[at])] if np.array_equal(x[at : at + len(item)], item)}
        if out:
            docs, items = zip(*sorted(out), strict=True)
            ones = pa.array(np.ones(len(out)))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64()), ones, ones, pa.array([True] * len(out))], names=["doc_id", "item_id", "cosine", "lcs", "answer_found"])


def contaminated(docs: DataFrame, benchmark: DataFrame, *, passage: int = PASSAGE, items: int = ITEMS) -> DataFrame:
    """doc_id, item_id, cosine, lcs (share of the item's words in order) and answer_found for every item in a document.

    Items without id, text or words and documents without id or text match nothing. Rows that repeat an id count as one
    document, with its best match for each item: by lcs, ties by cosine, then by the answer. A text of any length is
    looked at as a whole. Other columns are ignored; an empty table on either side gives no rows.
    """
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n_words = F.regexp_count("text", F.lit("[0-9A-Za-z[^\\x00-\\x7F]]+"))
    rows = rows.distinct().withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n_words / passage).cast("int") - 1))))
    count, out = rows.count(), None
    blocks = -(-count // items) if count else 0
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text", "piece"), F.lit(max(1, blocks))))
    for first in range(0, blocks, SHARED):
        part = rows.where(F.col("block").between(first, first + SHARED - 1)).groupBy("block", "item_id", "text").agg(F.collect_set("piece").alias("pieces"))
        wanted: dict[int, dict[tuple[int, str], set[int]]] = {}
        for r in part.collect():  # the items of SHARED blocks
            wanted.setdefault(r["block"], {})[r["item_id"], r["text"]] = set(r["pieces"])
        if not wanted:
            continue
        texts = sorted({t for some in wanted.values() for _, t in some})
        known = np.unique(word_hashes(*lower_bytes(pa.array(texts, pa.string())), SPACE)[0])
        if not len(known):
            continue
        encoded = written(sequences(docs, known), "sequences")
        for b in sorted(wanted):
            found = _block(encoded, known, wanted[b], passage=passage)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], PAIRS)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs", "cosine", "answer_found")).alias("m"))
    return best.select("doc_id", "item_id", "m.cosine", "m.lcs", "m.answer_found")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with no benchmark item in them, with all their columns, whatever these are called. Rows
    without id or text stay, and so do repeated rows."""
    ids = contaminated(docs.select("doc_id", "text"), benchmark, **options).select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct(*named(docs)).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(ids, "id", "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

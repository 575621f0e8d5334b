"""All pairs of a group's rows, in blocks of bounded size that many tasks share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096  # rows of a group that are compared together, about; two such blocks are what a task holds
STEP = 1 << 19  # pairs that a task looks at in one go
TASK, TASKS = 1 << 23, 2000  # pairs a task compares in all, about, and the most tasks


def in_blocks(rows: DataFrame, by: str, *, size: int = BLOCK, more: DataFrame | None = None) -> DataFrame:
    """``rows`` (id, ...) once for each pair of blocks i <= j of their group that their ``block`` is in, dealt by pair.

    Rows go to blocks by a hash of their id, so a group of n rows is moved n / ``size`` times, not once a partner; a
    group of up to ``size`` rows is one block and is moved once. Rows without a group are left out. ``more`` (id, ...) has
    further columns of some rows."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / size).cast("int"))
    work, moved = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n")), F.sum(F.col("n") * F.col("blocks"))).first()
    tasks = min(TASKS, max(math.ceil((work or 0) / TASK), math.ceil((moved or 0) / (4 * BLOCK)), 1))
    held = rows.join(sizes.drop("n"), by).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    held = held if more is None else held.join(more, "id", "left")
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")
    return held.repartition(tasks, by, "i", "j")


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of numbers a list, filled up with 0, and the lists' lengths; -1 for null."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    full, flat = np.maximum(sizes, 0), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(full.max(initial=0))))
    out[np.arange(out.shape[1]) < full[:, None]] = flat
    return out, sizes


class _Sparse:
    """Rows of numbered terms and their weights."""

    def __init__(self, terms: pa.Array, weights: pa.Array):
        self.size = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.terms, self.weights = terms.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False)
        self.row = np.zeros(int(self.terms.max(initial=0)) + 1)

    def dots(self, p: int, others: np.ndarray) -> np.ndarray:
        """The sums over common terms of row ``p`` with each of ``others``."""
        own = slice(self.begin[p], self.begin[p] + self.size[p])
        self.row[self.terms[own]] = self.weights[own]
        size = self.size[others]
        at = np.repeat(self.begin[others] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        products = self.row[self.terms[at]] * self.weights[at]
        out, some = np.zeros(len(others)), np.flatnonzero(size)
        if len(some):
            out[some] = np.add.reduceat(products, (np.cumsum(size) - size)[some])
        self.row[self.terms[own]] = 0.0
        return out


def _comparer(names: list[str], least: float | None, apart: bool, texts: bool, blend: tuple[float, float] | None) -> Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        column = lambda name: table.column(name).combine_chunks()
        ids, block, (i, j) = column("id"), column("block").to_numpy(), (k.as_py() for k in key[1:])
        place = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
        event = column("event_id").dictionary_encode().indices.to_numpy() if apart else None
        x, sizes = _padded(column("x"))
        lengths = np.zeros(len(x))
        for d in range(x.shape[1]):  # components are summed up one after the other, as SQL does
            lengths += x[:, d] * x[:, d]
        lengths = np.sqrt(lengths)
        void = (sizes < 0) | (lengths == 0)
        sparse = _Sparse(column("terms"), column("weights")) if texts else None
        with np.errstate(all="ignore"):
            unit = x / lengths[:, None] if least is not None else None
            flat = np.ascontiguousarray(x.T)
            left, right = (np.flatnonzero(block == k) for k in (i, j))
            step = max(1, STEP // max(1, len(right)))
            for begin in range(0, len(left), step):
                rows = left[begin : begin + step]
                hit = place[rows][:, None] < place[right] if i == j else place[rows][:, None] != place[right]
                if apart:
                    hit &= event[rows][:, None] != event[right]
                if least is not None:
                    hit &= ~(unit[rows] @ unit[right].T < least - 1e-9)
                p, q = np.nonzero(hit)
                p, q = rows[p], right[q]
                cosine = np.zeros(len(p))
                for d in flat:
                    cosine += d[p] * d[q]
                cosine /= lengths[p] * lengths[q]
                none = void[p] | void[q] | (sizes[p] != sizes[q])
                if least is not None:
                    keep = ~none & ~(cosine < least)
                    p, q, cosine, none = p[keep], q[keep], cosine[keep], none[keep]
                more = []
                if texts:
                    tfidf = np.zeros(len(p))
                    ends = np.flatnonzero(np.diff(p, prepend=-1, append=-1))
                    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                        tfidf[lo:hi] = sparse.dots(p[lo], q[lo:hi])
                    if blend is not None:
                        alpha, least_score = blend
                        score = np.clip(np.where(none, 0.0, alpha * tfidf + (1 - alpha) * cosine), 0.0, 1.0)
                        keep = ~(score < least_score)
                        p, q, cosine, none, tfidf = p[keep], q[keep], cosine[keep], none[keep], tfidf[keep]
                    more = [pa.array(tfidf)]
                if len(p):
                    first = place[p] < place[q]
                    a, b = np.where(first, p, q), np.where(first, q, p)
                    yield pa.RecordBatch.from_arrays([pa.repeat(key[0], len(p)), ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(cosine, mask=none), *more], names)

    return compare


def compared(rows: DataFrame, by: str, *, least: float | None = None, apart: bool = False, texts: DataFrame | None = None, blend: tuple[float, float] | None = None, size: int = BLOCK) -> DataFrame:
    """``by``, a, b, cosine of pairs a < b of a group's rows (id, x), each once; ``apart`` leaves out those of one
    ``event_id``, as well as rows without one.

    With ``least``, pairs of at least that cosine: a matrix product finds them, sums in the components' order are what
    is returned and decided by. Without it, all pairs: the cosine is null where a vector is null, zero or of another
    length than the other. With ``texts`` (id, terms, weights) also tfidf, the sum over common terms, 0 without a text;
    ``blend`` (alpha, least) then leaves out pairs whose blend of both, between 0 and 1, is less.
    """
    kinds = dict(rows.dtypes)
    held = rows.where(F.col("id").isNotNull() & F.col("event_id").isNotNull()) if apart else rows.where("id is not null")
    x = F.col("x").cast("array<double>")
    held = held.withColumn("x", F.when(F.forall(x, lambda v: v.isNotNull()), x))
    dealt = in_blocks(held.select(by, "id", *(["event_id"] if apart else []), "x"), by, size=size, more=texts)
    names = [by, "a", "b", "cosine", *([] if texts is None else ["tfidf"])]
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, [kinds[by], kinds["id"], kinds["id"], "double", "double"], strict=False))
    return dealt.groupBy(by, "i", "j").applyInArrow(_comparer(names, least, apart, texts is not None, blend), schema)

"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows more?

Fitting, on a bounded sample of labelled documents (``MAX_DOCS`` a class of at most ``MAX_CHARS`` characters, chosen by
a hash of the id): one half trains the dictionaries. Both end with the ordinary class's most frequent words, so that
plain text is as long under either, and begin with the words that tell their own class from the other. zstandard's own
trainer picks what is frequent in a class, which is the same in both, so content is chosen here and given to it raw.
The other half calibrates: how much likelier a window that the toxic dictionary makes shorter by so many bytes is in a
toxic document, and a logistic function of a document's most telling windows and of how many pass the thresholds.

A window is ``WINDOW`` words with their blanks, a new one every ``STEP`` words and one that ends the text. Scoring takes each document alone, every
window of its whole text, in one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MAX_DOCS, MAX_CHARS = 3000, 20_000  # bounds of the sample for fitting: documents of each class, characters of each
WINDOW, STEP = 4, 4  # words
COMMON_BYTES, OWN_BYTES = 32768, 16384
LEVELS = (6, 12)  # of compression; zstandard's way of matching depends on level and size together, so the better one is kept
LEAST_DOCS, LEAST_RATIO = 3, 20.0  # a word that tells a class: in so many documents, so much likelier than in the other
THRESHOLDS = (1.0, 2.0)  # calibrated log-likelihoods over which windows are counted
END = b"\n" * 8  # zstandard begins no match in the last eight bytes
CACHE_WINDOWS = 300_000
EDGE = re.compile(r"\A\W+|\W+\Z")


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    gains: dict[int, float]  # bytes that the toxic dictionary saves on a window, and the log-likelihood it stands for
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    level: int = LEVELS[0]


def windows(text: str) -> list[bytes]:
    """A window every ``STEP`` words and one that ends with the text, so that every word is in one."""
    words = text.lower().split()
    if not words:
        return []
    last = max(0, len(words) - WINDOW)
    starts = [*range(0, last, STEP), last]
    return [f" {' '.join(words[i : i + WINDOW])} ".encode("utf-8", "replace") + END for i in starts]


class Scorer:
    """Holds a model's compressors and what the last windows gained; at most ``CACHE_WINDOWS`` of them, as copies recur."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.compressors = [self._compressor(d, model.level) for d in (model.ordinary, model.toxic)]

    @staticmethod
    def _compressor(data: bytes, level: int):
        import zstandard

        if not data:
            return zstandard.ZstdCompressor(level=level, write_content_size=False)
        held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_dict_id=False)

    def saved(self, window: bytes) -> int:
        """Bytes by which the window is shorter under the toxic dictionary."""
        found = self.known.get(window)
        if found is None:
            if len(self.known) >= CACHE_WINDOWS:
                self.known.clear()
            a, b = self.compressors
            found = self.known[window] = len(a.compress(window)) - len(b.compress(window))
        return found

    def evidence(self, text: str) -> np.ndarray:
        """The largest log-likelihood of a text's windows, the mean of the three largest, the mean of all, the share and
        the logarithm of the number of those over the first threshold, the logarithm of those over the second."""
        gains = self.model.gains
        found = np.array([gains.get(self.saved(w), 0.0) for w in windows(text)])
        if not len(found):
            return np.zeros(6)
        top = np.partition(found, -3)[-3:] if len(found) > 3 else found
        over = [(found > t).sum() for t in THRESHOLDS]
        return np.array([top.max(), top.mean(), found.mean(), over[0] / len(found), np.log1p(over[0]), np.log1p(over[1])])

    def score(self, text: str | None) -> float:
        x = np.append((self.evidence(text or "") - self.model.mean) / self.model.scale, 1.0)
        return float(1 / (1 + np.exp(-np.clip(x @ self.model.weights, -30, 30))))


def _documents_with(texts: list[str]) -> Counter[str]:
    return Counter(w for t in texts for w in {EDGE.sub("", w) for w in t.lower().split()})


def _telling(own: Counter[str], n: int, other: Counter[str], m: int) -> list[str]:
    """Words of one class that are much likelier in it, the most likely last."""
    lift = {w: (own[w] / n) / ((other[w] + 1) / m) for w in own if own[w] >= LEAST_DOCS and len(w) > 2}
    return sorted((w for w in lift if lift[w] >= LEAST_RATIO), key=lambda w: (own[w] * np.log(lift[w]), w))


def _content(words: list[str], most: int) -> bytes:
    return f" {' '.join(words)} ".encode()[-most:] if words else b""


def fit(texts: list[str], toxic: list[int], ids: list[int], *, odds: float | None = None) -> Model:
    """A model from labelled texts; without one of the classes it scores everything with the other's share. ``odds`` of
    toxic to ordinary documents take the place of the sample's own."""
    half = [zlib.crc32(f"half {i}".encode()) & 1 for i in ids]
    train = [[t for t, y, h in zip(texts, toxic, half, strict=True) if y == c and not h] for c in (0, 1)]
    n0, n1 = (max(1, len(x)) for x in train)
    c0, c1 = map(_documents_with, train)
    bad, good = _telling(c1, n1, c0, n0), _telling(c0, n0, c1, n1)
    apart = {*bad, *good}
    common = _content([w for w, _ in sorted(c0.items(), key=lambda x: (x[1], x[0])) if w not in apart], COMMON_BYTES)
    dictionaries = _content(bad, OWN_BYTES) + common, _content(good, OWN_BYTES) + common
    rest = [(t, y) for t, y, h in zip(texts, toxic, half, strict=True) if h]
    y = np.array([y for _, y in rest], float)
    if not 0 < y.sum() < len(y):
        weights = np.append(np.zeros(6), 30.0 if y.sum() else -30.0)
        return Model(*dictionaries, {}, weights, np.zeros(6), np.ones(6))
    return max((_calibrated(Model(*dictionaries, {}, np.zeros(7), np.zeros(6), np.ones(6), level), rest, y, odds) for level in LEVELS), key=lambda x: x[0])[1]


def _calibrated(model: Model, rest: list[tuple[str, int]], y: np.ndarray, odds: float | None) -> tuple[float, Model]:
    """The likelihood of the calibrating half, and the model with its gains and weights."""
    scorer, seen = Scorer(model), [Counter(), Counter()]
    for t, c in rest:
        seen[c].update({scorer.saved(w) for w in windows(t)})
    m = len(y) - y.sum(), y.sum()
    for saved in seen[0].keys() | seen[1].keys():
        model.gains[saved] = float(np.log((seen[1][saved] + 0.5) / (m[1] + 1)) - np.log((seen[0][saved] + 0.5) / (m[0] + 1)))
    x = np.array([scorer.evidence(t) for t, _ in rest])
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    x = np.hstack([(x - model.mean) / model.scale, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton's steps of a lightly penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-6, 1 - 1e-6)
    if odds:
        w[-1] += np.log(odds) - np.log(m[1] / m[0])
    model.weights = w
    return float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum()), model


def fold(doc_id) -> F.Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5


def fit_on(docs: DataFrame, labels: DataFrame, *, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> Model:
    """Fit on the bounded sample of labelled rows outside the held-out fold, with the odds of all of these. The driver
    gets ``2 * max_docs`` texts of ``max_chars`` characters at most, each id once. No rows: everything is ordinary."""
    known = labels.where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id")) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    # twice as many ids as are used, for those without a text or with one over the bound
    first = lambda df, n: df.orderBy(F.xxhash64("id"), "id").limit(n)
    ids = [first(known.where(F.col("toxic") == c), 2 * max_docs) for c in (0, 1)]
    ids = ids[0].unionByName(ids[1])
    usable = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= max_chars)
    found = usable.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))
    found = first(found.where("toxic = 0"), max_docs).unionByName(first(found.where("toxic = 1"), max_docs)).toPandas()
    found = found.sort_values("id")
    odds = counts[1] / counts[0] if counts.get(0) and counts.get(1) else None
    return fit(list(found.text), [int(y) for y in found.toxic], [int(i) for i in found.id], odds=odds)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. Null and empty texts get the score of no evidence; null ids
    are kept and held_out is null for them. Repeated rows get equal scores. A text of any length is scored by all its
    windows. Other columns of ``docs`` are ignored; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most OWN_BYTES and COMMON_BYTES, a small table

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = np.array([scorer.score(t.as_py()) for t in batch.column("text")])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": found, "predicted": (found >= 0.5).astype("i4")})

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = out.mapInArrow(scored, "doc_id long, score double, predicted int")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` predicted as not toxic, with all their columns, whatever these are called. Null and empty texts
    have the score of no evidence; repeated rows stay or go together; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py()) < 0.5 for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit_on(docs, labels))

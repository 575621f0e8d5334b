"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet in a corpus.

Both tokenisations of a text are arrays of byte offsets at which tokens end. Where both end, the text is cut into
groups. The walk over the two arrays compares them at the current index shift, first one end, then stretches twice as
long each time: an equal stretch is as many groups of one token each and is jumped over as a whole. Where a stretch
differs, shorter ones find the place; the irregular group there is resolved end by end, each pair of tokens that share
bytes being a link, and the shift becomes the difference of the indices behind it.

A byte-level BPE and a piece model without pieces that go on over a blank, a line feed or from letters into punctuation
both encode a part (a word with the blank or line feed before it) as they do within the text. So the walk goes over all
parts of a batch that are not yet known, laid end to end, and what it finds for a part is kept. Texts with other white
space are walked over as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain, zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .tokens import BYTES, LETTERS, LINE, PRINTED, in_slices

#: Parts, and first letters of parts, kept by one Python worker; what comes later is aligned each time it is met.
CACHE_PARTS = 300_000
#: Most id pairs that are sent to every task as two arrays (13 bytes a pair); with more, links meet counts in a join.
LOOKUP_PAIRS = 4_000_000
#: Characters of a text of plain white space that are in work at once.
CHUNK = 1_000_000
BLANK = "▁"
BAD = (-1, b"", b"")
#: Pieces that would go on over a blank, over a line feed, or from letters into ASCII that is no letter.
ACROSS = re.compile(f"[^{BLANK}]{BLANK}|\n|[A-Za-zÀ-ÖØ-öø-ÿ][!-@\\[-`{{-~]")

_loaded: dict[tuple[str, str], Aligner] = {}


def walk(a: list[int], b: list[int]) -> tuple[list[tuple[int, int, int]], list[list[tuple[int, int]]]]:
    """Groups in order as stretches (first index in ``a``, in ``b``, number of one-to-one groups), each but the last
    followed by one irregular group, the list of its links. Both lists of ends ascend and have the same last one."""
    i = j = 0
    n, m = len(a), len(b)
    stretches, irregular = [], []
    while True:
        first, other, step = i, j, 1
        while i < n and a[i : i + step] == b[j : j + step]:  # probes grow until one differs
            i, j, step = i + step, j + step, step * 2
        if i < n:
            while step > 1:  # then shrink
                step //= 2
                if a[i : i + step] == b[j : j + step]:
                    i, j = i + step, j + step
        i, j = min(i, n), min(j, m)
        stretches.append((first, other, i - first))
        if i == n:
            return stretches, irregular
        links, x, y = [(i, j)], a[i], b[j]
        while x != y:  # the end that comes first moves on, until both meet
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
            links.append((i, j))
        irregular.append(links)
        i, j = i + 1, j + 1


class Aligner:
    """Encodes with both tokenizers. What is known of a string is (tokens of a times 2^32 plus tokens of b, groups as
    text, links as codes), or BAD where either tokenizer doesn't give back its bytes."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        printed = {chr(c): c for c in PRINTED} | {chr(c): b for b, c in BYTES.items()}
        size = self.a.get_vocab_size()
        self.bytes_a = [bytes(printed.get(c, 63) for c in self.a.id_to_token(i) or "") for i in range(size)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([*map(len, x)], "i8") for x in (self.bytes_a, self.bytes_b))
        self.text_a, self.text_b = [*map(str, range(size))], [*map(str, range(len(pieces)))]
        self.size_b = len(pieces)
        self.wide = np.dtype("<i4" if size * self.size_b < 1 << 31 else "<i8")
        self.blank = self.b.piece_to_id(BLANK)
        plain = type(self.a.pre_tokenizer).__name__ == "ByteLevel" and self.a.normalizer is None
        real = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.apart = plain and not any(ACROSS.search(p) for p in real)
        self.parts: dict[str, tuple] = {}
        self.words: dict[str, tuple] = {}
        self.rests: dict[str, tuple] = {}

    def __call__(self, texts: list[str | None]) -> list[tuple[int, int, bytes, np.ndarray, bytes]]:
        """For each text: tokens of a and b, sha256 of the groups in hex, the links' codes, and the groups as text. What
        is new in all of them is learnt at once."""
        found: list = [None] * len(texts)
        for i, t in enumerate(texts):
            if t and self.apart and " ".join(t.split()) == t.replace(LINE, " "):
                found[i] = t.replace(LINE, " " + LINE).split(" ") if len(t) <= CHUNK else self._joined(self._chunks(t))
            else:
                found[i] = self._joined([self._learn([" " + t], [t])] if t else [])
        plain = [i for i, x in enumerate(found) if isinstance(x, list)]
        for i, known in zip(plain, self._known([found[i] for i in plain]), strict=True):
            found[i] = self._joined([known])
        return found

    def _joined(self, chunks: Iterable[list[tuple]]) -> tuple[int, int, bytes, np.ndarray, bytes]:
        total, said, codes = 0, [], []
        for found in chunks:
            if BAD in found:
                said = []
                break
            counts, groups, links = zip(*found, strict=True)
            total += sum(counts)
            said.append(b";".join(groups))
            codes.append(b"".join(links))
        if not said:
            return 0, 0, b"", np.zeros(0, self.wide), b""
        groups = b";".join(said)
        return total >> 32, total & (1 << 32) - 1, hashlib.sha256(groups).hexdigest().encode(), np.frombuffer(b"".join(codes), self.wide), groups

    def _chunks(self, text: str) -> Iterator[list[tuple]]:
        at = 0
        while at < len(text):
            end = text.find(" ", at + CHUNK)
            end = len(text) if end < 0 else end
            yield from self._known([text[at:end].replace(LINE, " " + LINE).split(" ")])
            at = end + 1

    def _known(self, texts: list[list[str]]) -> list[list[tuple]]:
        """What is known of the parts of each text."""
        known = self.parts
        found = [[*map(known.get, parts)] for parts in texts]
        gaps = [i for i, x in enumerate(found) if None in x]
        if gaps:
            late = [*dict.fromkeys(p for i in gaps for p, x in zip(texts[i], found[i], strict=True) if x is None)]
            new = dict(zip(late, self._parts(late), strict=True))
            if len(known) < CACHE_PARTS:
                known.update(new)
            for i in gaps:
                found[i] = [new[p] if x is None else x for p, x in zip(texts[i], found[i], strict=True)]
        return found

    def _parts(self, parts: list[str]) -> list[tuple]:
        """A part's first letters and its rest apart, as neither tokenizer goes on from one into the other."""
        halves = []
        for p in parts:
            m = LETTERS.match(p, p[0] == LINE)
            halves.append((p[: m.end()], p[m.end() :]) if m else (p, ""))
        words, rests = self.words, self.rests
        late = [*dict.fromkeys(w for w, _ in halves if w not in words)]
        new_words = dict(zip(late, self._learn([w if w[0] == LINE else " " + w for w in late], late), strict=True))
        late = [*dict.fromkeys(r for _, r in halves if r and r not in rests)]
        new_rests = dict(zip(late, self._learn(late, [LINE + r for r in late], 2), strict=True))
        out = []
        for w, r in halves:
            x = new_words.get(w) or words[w]
            if r:
                y = new_rests.get(r) or rests[r]
                x = (x[0] + y[0], x[1] + b";" + y[1], x[2] + y[2]) if x is not BAD and y is not BAD else BAD
            out.append(x)
        for known, new in ((words, new_words), (rests, new_rests)):
            if len(known) < CACHE_PARTS:
                known.update(new)
        return out

    def _learn(self, strings: list[str], plain: list[str], extra: int = 1) -> list[tuple]:
        """What is to be known of ``strings``. ``plain`` is what the second tokenizer is given; where a string doesn't
        begin with a blank, the first ``extra`` pieces of it (a blank, a line feed) are not the string's."""
        if not strings:
            return []
        ids_a = [e.ids for e in self.a.encode_batch_fast(strings, add_special_tokens=False)]
        ids_b = self.b.encode(plain, num_threads=1)
        ids_b = [x if s[0] == " " else x[extra:] for s, x in zip(strings, ids_b, strict=True)]
        raw = [s.encode() for s in strings]
        flat_a, flat_b = [*chain.from_iterable(ids_a)], [*chain.from_iterable(ids_b)]
        ends_a, ends_b = self.sizes_a[flat_a].cumsum(), self.sizes_b[flat_b].cumsum() if flat_b else np.zeros(0, "i8")
        parts_a, parts_b = np.cumsum([*map(len, ids_a)]), np.cumsum([*map(len, ids_b)])
        sizes, whole = np.cumsum([*map(len, raw)]), b"".join(raw)
        bytes_a, bytes_b = b"".join(map(self.bytes_a.__getitem__, flat_a)), b"".join(map(self.bytes_b.__getitem__, flat_b))
        if not (whole == bytes_a == bytes_b and (ends_a[parts_a - 1] == sizes).all() and (ends_b[parts_b - 1] == sizes).all()):
            return self._some(strings, plain, extra, raw, ids_a, ids_b)
        stretches, irregular = walk(ends_a.tolist(), ends_b.tolist())
        said, firsts, links_a, links_b = [], [], [], []
        text_a, text_b = [self.text_a[i] for i in flat_a], [self.text_b[i] for i in flat_b]
        for (i, j, n), links in zip_longest(stretches, irregular, fillvalue=()):
            if n:
                said += map("|".join, zip(text_a[i : i + n], text_b[j : j + n], strict=True))
                firsts += range(i, i + n)
                links_a += range(i, i + n)
                links_b += range(j, j + n)
            if links:
                (i, j), (k, m) = links[0], links[-1]
                said.append(f"{','.join(text_a[i : k + 1])}|{','.join(text_b[j : m + 1])}")
                firsts.append(i)
                links_a += [x for x, _ in links]
                links_b += [y for _, y in links]
        codes = (np.array(flat_a, "i8")[links_a] * self.size_b + np.array(flat_b, "i8")[links_b]).astype(self.wide).tobytes()
        groups = np.searchsorted(firsts, parts_a)
        width, out, group, link = self.wide.itemsize, [], 0, 0
        for a, b, g, last in zip(ids_a, ids_b, groups.tolist(), ((parts_a + parts_b - groups) * width).tolist(), strict=True):
            out.append(((len(a) << 32) + len(b), ";".join(said[group:g]).encode(), codes[link:last]))
            group, link = g, last
        return out

    def _some(self, strings, plain, extra, raw, ids_a, ids_b) -> list[tuple]:
        """The same where some strings are BAD."""
        fits = [b"".join(map(self.bytes_a.__getitem__, a)) == s == b"".join(map(self.bytes_b.__getitem__, b)) for s, a, b in zip(raw, ids_a, ids_b, strict=True)]
        good = iter(self._learn(*([x for x, fit in zip(xs, fits, strict=True) if fit] for xs in (strings, plain)), extra))
        return [next(good) if fit else BAD for fit in fits]


def aligner(path_a: str, path_b: str) -> Aligner:
    """One a Python worker and pair of files; it lives as long as the worker."""
    if (path_a, path_b) not in _loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


def align(docs: DataFrame, path_a: str, path_b: str, *, with_groups: bool = False) -> DataFrame:
    """A written table with a row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, the
    codes of its different links (id of a times the size of b's vocabulary, plus id of b, ascending) and how often each
    stands there; the groups themselves as ``groups`` if asked for.

    Null and empty texts, and texts that either tokenizer doesn't give back byte for byte, have no tokens. Null ids are
    kept, rows that repeat an id or a text each have their row. A text of any length is aligned whole. Other columns of
    ``docs`` are ignored; an empty table gives no rows.
    """
    number = "int" if aligner(path_a, path_b).wide.itemsize == 4 else "long"
    schema = f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<{number}>, times array<int>" + (", groups string" if with_groups else "")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in in_slices(texts):
                found = both(texts[part])
                pairs = [np.unique(x[3], return_counts=True) for x in found]
                offsets = np.concatenate([[0], np.cumsum([len(c) for c, _ in pairs])]).astype("i4")
                n_a, n_b, n_links = np.array([x[0] for x in found], "i8"), np.array([x[1] for x in found], "i8"), np.array([len(x[3]) for x in found], "i8")
                columns = [batch.column("doc_id")[part], n_a, n_b, n_a + n_b - n_links, n_links, [x[2].decode() for x in found]]
                columns += [pa.ListArray.from_arrays(offsets, np.concatenate([x[i] for x in pairs]).astype(both.wide if i == 0 else "i4")) for i in (0, 1)]
                columns += [[x[4].decode() for x in found]] if with_groups else []
                yield pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], [c.split()[0] for c in schema.split(", ")])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(wanted.mapInArrow(aligned, schema).withColumn("row", F.monotonically_increasing_id()), "alignment")


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """code, id_a, id_b, count and best of every pair of ids that any document of ``aligned`` holds linked: the number
    of such documents, and whether no other pair of the same id of a has more. A written table."""
    code, count = F.col("code").cast("long"), F.count("*").cast("long").alias("count")
    counts = aligned.select(F.explode("codes").alias("code")).groupBy("code").agg(count)
    counts = counts.select("code", F.floor(code / size_b).alias("id_a"), (code % size_b).alias("id_b"), "count")
    return written(counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("id_a"))), "pair_counts")


RATED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rate(aligned: DataFrame, counts: DataFrame, *, most: int = LOOKUP_PAIRS) -> DataFrame:
    """``aligned`` with n_best, the number of a document's links that are best, and count_sum, the sum of their counts.
    Up to ``most`` pairs are sent to all tasks, more meet the links in a join; the results are the same."""
    if counts.count() > most:
        links = aligned.select("row", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("row", F.col("x.codes").alias("code"), F.col("x.times").cast("long").alias("times"))
        sums = links.join(counts, "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
        return aligned.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"]).select(RATED)
    held = counts.select("code", "count", "best").toArrow().sort_by("code")
    shared = aligned.sparkSession.sparkContext.broadcast([held.column(c).to_numpy() for c in held.column_names])

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, count, best = shared.value
        for batch in batches:
            lists, times = batch.column("codes"), batch.column("times").flatten().to_numpy()
            found = np.searchsorted(codes, lists.flatten().to_numpy())
            ends = np.cumsum(np.concatenate([[0], lists.value_lengths().to_numpy()]))
            for name, values in (("n_best", times * best[found]), ("count_sum", times * count[found])):
                before = np.concatenate([[0], np.cumsum(values.astype("i8"))])
                batch = batch.append_column(name, pa.array(before[ends[1:]] - before[ends[:-1]]))
            yield batch.select(RATED)

    given = aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times")
    return given.mapInArrow(rated, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = align(table(spark, sf_dir, "documents"), *paths)
    return rate(aligned, pair_counts(aligned, aligner(*paths).size_b))

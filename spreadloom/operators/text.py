"""Similarity of texts and embeddings, and the graphs made of it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_tokens, terms
from ..sources.shared import shared_dir, written
from .blocks import compared, in_blocks


def _codes(lines: str | None, known: dict[str, int], grow: bool) -> np.ndarray:
    """Words of lines, as their numbers from 1, and pairs of neighbours on a line, as both numbers in one. ``grow``
    numbers unknown words, which else are left out."""
    out = []
    for line in (lines or "").split("\n"):
        words = line.split()
        w = np.array([known.setdefault(t, len(known) + 1) for t in words] if grow else [known.get(t, 0) for t in words], np.int64)
        out += [w[w > 0], (w[:-1] << 32 | w[1:])[(w[:-1] > 0) & (w[1:] > 0)]]
    return np.concatenate(out)


#: Terms that a task counts at a time, words that it holds numbered, and ids that are sent to all tasks.
COUNTED, NUMBERED, SENT = 1 << 20, 1 << 20, 1 << 20


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, df, total of some documents at a time."""
    known: dict[str, int] = {}
    every: list[np.ndarray] = []

    def told() -> pa.RecordBatch:
        codes, total = np.unique(np.concatenate([*every, np.zeros(0, np.int64)]), return_counts=True)
        df = np.unique(np.concatenate([*map(np.unique, every), np.zeros(0, np.int64)]), return_counts=True)[1]
        names = ["", *known]
        term = [f"{names[a]} {names[b]}" if a else names[b] for a, b in zip((codes >> 32).tolist(), (codes & 0xFFFFFFFF).tolist(), strict=True)]
        every.clear()
        return pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(df, pa.int64()), pa.array(total, pa.int64())], ["term", "df", "total"])

    held = 0
    for batch in batches:
        for lines in batch.column("lines"):
            every.append(_codes(lines.as_py(), known, True))
            held += len(every[-1])
            if held >= COUNTED:
                yield told()
                held = 0
                if len(known) > NUMBERED:
                    known.clear()
    yield told()


def tfidf_vectors(docs: DataFrame, *, max_df: float = 0.6, least_docs: int = 25, most_terms: int = 50_000, named: bool = False, only: DataFrame | None = None) -> DataFrame:
    """id, terms, weights: smoothed TF-IDF of length 1 a document over words and pairs of words, of the ``most_terms`` most
    frequent terms (ties by name) in at most ``max_df`` of the documents. Documents without any are left out; those that
    share an id are one, of which pairs of words don't span two texts. Terms are numbers, or names with ``named``. ``only``
    (id) leaves out vectors of other documents, whose terms count nevertheless.

    Only the terms' counts are shuffled. The vocabulary is bounded and is sent to all tasks, which weigh a document as a
    whole.
    """
    spark = docs.sparkSession
    n = docs.count()
    lines = docs.select("id", F.array_join(terms(F.col("text")), " ").alias("lines"))
    if not docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        lines = lines.groupBy("id").agg(F.array_join(F.collect_list("lines"), "\n").alias("lines"))
    counts = lines.select("lines").mapInArrow(_count, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    held = counts.where(F.lit(n < least_docs) | (F.col("df") <= max_df * n)).orderBy(F.desc("total"), "term").limit(most_terms)
    rows = held.select("term", (F.log((F.lit(1.0) + n) / (1 + F.col("df"))) + 1).alias("idf")).collect()
    known: dict[str, int] = {}
    for r in rows:
        for word in r["term"].split():
            known.setdefault(word, len(known) + 1)
    codes = np.array([reduce(lambda a, b: a << 32 | b, map(known.__getitem__, r["term"].split())) for r in rows], np.int64)
    order = codes.argsort()
    shared = spark.sparkContext.broadcast((known, codes[order], np.array([r["idf"] for r in rows])[order], np.array([r["term"] for r in rows], object)[order]))  # of most_terms terms

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codes, idf, names = shared.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                keep, numbers, weights, ends = [], [np.zeros(0, np.int64)], [np.zeros(0)], [0]
                for row, lines in enumerate(batch.column("lines").to_pylist()):
                    found, times = np.unique(_codes(lines, known, False), return_counts=True)
                    at = np.searchsorted(codes, found)
                    at[at == len(codes)] = 0
                    held = codes[at] == found if len(codes) else np.zeros(0, bool)
                    at, times = at[held], times[held]
                    if len(at):
                        raw = times * idf[at]
                        numbers.append(at)
                        weights.append(raw / math.sqrt(float(raw @ raw)))
                        keep.append(row)
                        ends.append(ends[-1] + len(at))
                at, ends = np.concatenate(numbers), pa.array(ends, pa.int32())
                term = pa.array(names[at], pa.string()) if named else pa.array(at, pa.int32())
                out = [pa.ListArray.from_arrays(ends, term), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(weights)))]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keep, pa.int64())), *out], ["id", "terms", "weights"])

    if only is not None:
        wanted = only.select("id").distinct()
        lines = lines.join(F.broadcast(wanted) if wanted.count() <= SENT else wanted, "id", "left_semi")
    return lines.mapInArrow(weigh, f"id {dict(docs.dtypes)['id']}, terms array<{'string' if named else 'int'}>, weights array<double>")


def tfidf_weights(docs: DataFrame, **options: float) -> DataFrame:
    """id, term, w: the vectors of ``tfidf_vectors``, a row a term."""
    both = F.explode(F.arrays_zip("terms", "weights")).alias("e")
    return tfidf_vectors(docs, named=True, **options).select("id", both).select("id", F.col("e.terms").alias("term"), F.col("e.weights").alias("w"))


def tfidf_cosine(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Cosine of candidate pairs (a, b) only, summed over common terms."""
    left = pairs.join(weights.withColumnsRenamed({"id": "a", "w": "wa"}), "a")
    both = left.join(weights.withColumnsRenamed({"id": "b", "w": "wb"}), ["b", "term"])
    cos = both.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("tfidf"))
    return pairs.join(cos, ["a", "b"], "left").withColumn("tfidf", F.coalesce("tfidf", F.lit(0.0)))


def unit(x):
    x = x.cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(x, lambda v: v / F.nullif(norm, F.lit(0.0)))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


#: Hashed vectors go to buckets of about BUCKET vectors, of at most BITS bits.
BUCKET, BITS = 64, 12


def lsh_tables(least: float, recall: float, bits: int) -> int:
    """Tables of ``bits`` signs after which a pair at the threshold has met with probability ``recall``: a random plane
    parts two vectors with the probability of their angle over pi."""
    together = (1 - math.acos(least) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - together))) if bits else 1


def _buckets(vectors: DataFrame, least: float, recall: float) -> DataFrame:
    """category, id, event_id and the buckets of each vector, one a table, numbered over all tables."""
    tables = [lsh_tables(least, recall, k) for k in range(BITS + 1)]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            bits, sizes = batch.column("bits").to_numpy(), batch.column("x").value_lengths().to_numpy()
            flat, ends = batch.column("x").flatten().to_numpy(), np.cumsum(sizes)
            out: list = [None] * len(bits)
            for k, size in {*zip(bits.tolist(), sizes.tolist(), strict=True)}:
                if (k, size) not in planes:
                    planes[k, size] = np.random.default_rng(k * 100_003 + size).standard_normal((size, tables[k] * k))
                rows = np.flatnonzero((bits == k) & (sizes == size))
                x = np.stack([flat[ends[r] - size : ends[r]] for r in rows])
                signs = (x @ planes[k, size] > 0).reshape(len(rows), tables[k], k)
                number = signs @ (1 << np.arange(k)) + (np.arange(tables[k]) << k)
                for r, n in zip(rows, number, strict=True):
                    out[r] = n.astype("i8")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("category", "id", "event_id")), pa.array(out, pa.list_(pa.int64()))], ["category", "id", "event_id", "buckets"])

    kinds = dict(vectors.dtypes)
    return vectors.select("category", "id", "event_id", "x", "bits").mapInArrow(signed, f"category {kinds['category']}, id {kinds['id']}, event_id {kinds['event_id']}, buckets array<long>")


def lsh_pairs(vectors: DataFrame, *, least: float, recall: float) -> DataFrame:
    """category, a, b: pairs that share a bucket of random planes, each once. ``bits`` beside each vector."""
    rows = _buckets(vectors, least, recall).withColumn("bucket", F.explode("buckets")).drop("buckets")
    left = rows.select("category", "bucket", F.col("id").alias("a"), F.col("event_id").alias("ea"))
    right = rows.select("category", "bucket", F.col("id").alias("b"), F.col("event_id").alias("eb"))
    return left.join(right, ["category", "bucket"]).where("a < b and ea <> eb").select("category", "a", "b").distinct()


def cosine_candidates(vectors: DataFrame, *, least: float = 0.45, recall: float = 0.99, few: int | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Pairs a < b of a category and of different events with a cosine of at least ``least``: all of them, from blocks of
    vectors that are compared in tasks of bounded size. Only vectors are shuffled, pairs are not.

    With ``few``, categories of more vectors than that are hashed by the sides of random planes that vectors lie on, into
    so many tables that a pair at the threshold shares a bucket with probability ``recall`` and closer pairs with more;
    the cosines of pairs that do are exact. Buckets hold about ``BUCKET`` vectors at any size, so the join's rows are the
    vectors times the tables, which grow as a small power of the size, in place of its square. For thresholds near 0
    hashing tells nothing and tables are many.

    With ``weights`` (id, terms, weights, as of ``tfidf_vectors``) also tfidf, the cosine of both ends' texts, 0 without
    common terms; then nothing is hashed.
    """
    held = vectors.select("category", "id", "event_id", "x")
    if weights is not None:
        return compared(held, "category", least=least, apart=True, texts=weights)
    if few is None:
        return compared(held, "category", least=least, apart=True)
    sizes = vectors.groupBy("category").agg(F.count("*").alias("n")).withColumn("bits", F.least(F.floor(F.log2(F.col("n") / BUCKET)), F.lit(BITS)).cast("int"))
    many = sizes.where(F.col("n") > few)
    pairs = compared(held.join(many.select("category"), "category", "left_anti"), "category", least=least, apart=True)
    if not many.isEmpty():
        large = held.withColumn("x", unit(F.col("x"))).where("x is not null").join(many.select("category", "bits"), "category")
        met = lsh_pairs(large, least=least, recall=recall)
        x = lambda name: large.select("category", F.col("id").alias(name), F.col("x").alias(f"x{name}"))
        both = met.join(x("a"), ["category", "a"]).join(x("b"), ["category", "b"])
        pairs = pairs.unionByName(both.select("category", "a", "b", dot(F.col("xa"), F.col("xb")).alias("cosine")).where(F.col("cosine") >= least))
    return pairs


def cap_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """The ``n`` best pairs of each category."""
    best = Window.partitionBy("category").orderBy(F.desc("cosine"), "a", "b")
    return pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= n).drop("r")


def best_pairs(pairs: DataFrame) -> DataFrame:
    """Each pair once, by its best cosine over categories; ties to the first category."""
    return pairs.groupBy("a", "b").agg(F.max("cosine").alias("cosine"), F.min_by("category", F.struct(-F.col("cosine"), "category")).alias("category"))


def edge_score(pairs: DataFrame, *, alpha: float = 0.5, least: float = 0.0) -> DataFrame:
    score = F.least(F.greatest(alpha * F.col("tfidf") + (1 - alpha) * F.col("cosine"), F.lit(0.0)), F.lit(1.0))
    return pairs.withColumn("score", score).where(F.col("score") >= least)


def cluster_pairs(members: DataFrame, *, cross_event: bool = False) -> DataFrame:
    """All pairs a < b of a cluster; ``cross_event`` leaves out those of one event. Large clusters are dealt to tasks in
    blocks."""
    more = ["event_id"] if cross_event else []
    dealt = in_blocks(members.select("cluster", "id", *more), "cluster")
    left, right = (dealt.where(F.col("block") == F.col(k)).select("cluster", "i", "j", F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in more]) for k, x in (("i", "a"), ("j", "b")))
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # of one origin, so named anew
    pairs = left.join(right, ["cluster", "i", "j"]).where("case when i = j then a < b else a <> b end")
    pairs = pairs.where("event_id_a <> event_id_b") if cross_event else pairs
    return pairs.select("cluster", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def cluster_edge_score(members: DataFrame, vectors: DataFrame, weights: DataFrame, *, alpha: float = 0.5, least: float = 0.0, cross_event: bool = False) -> DataFrame:
    """cluster, a, b, tfidf, cosine and their blend of all pairs inside clusters; ``weights`` as of ``tfidf_vectors``."""
    held = members.join(vectors.select("id", "x"), "id")
    return edge_score(compared(held, "cluster", apart=cross_event, texts=weights, blend=(alpha, least)), alpha=alpha, least=least)


def typed_edges(members: DataFrame, cosines: DataFrame) -> DataFrame:
    """Edges between all members (group, id, relation, rank, seq) of a group of two or more: from a lower rank to a
    higher one where the group's relation, its first member's, implies, else in the members' order and undirected; with
    the cosine of the two (a < b), if there is one. A missing rank comes last."""
    first = members.groupBy("group").agg(F.upper(F.trim(F.min_by("relation", "seq"))).alias("kind"))
    held = members.select("group", "id", "seq", F.coalesce(F.col("rank").try_cast("double"), F.lit(9999.0)).alias("rank")).join(first, "group")
    implies = F.contains("kind", F.lit("IMPLIES"))
    held = held.withColumn("place", F.struct(F.when(implies, F.col("rank")).otherwise(F.lit(0.0)).alias("r"), "seq"))
    a = held.select("group", "kind", F.col("id").alias("source"), F.col("place").alias("pa"))
    b = held.select("group", F.col("id").alias("target"), F.col("place").alias("pb"))
    edges = a.join(b, "group").where("pa < pb").select("group", "source", "target", F.col("kind").alias("relation"), F.contains("kind", F.lit("IMPLIES")).alias("directed"), F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    return edges.join(cosines.select("a", "b", "cosine"), ["a", "b"], "left").drop("a", "b")


def degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def near_dup(pairs: DataFrame, *, least: float = 0.85) -> DataFrame:
    """Of pairs with texts ta, tb, or their tokens sa, sb: the Jaccard similarity of their tokens; empty sets are never
    near duplicates. Where a text is in many pairs, give tokens that were taken once a text."""
    held = pairs if "sa" in pairs.columns else pairs.withColumns({"sa": norm_tokens(F.col("ta")), "sb": norm_tokens(F.col("tb"))})
    held = held.withColumns({"na": F.size("sa"), "nb": F.size("sb")}).where((F.col("na") > 0) & (F.col("nb") > 0))
    held = held.where(F.least("na", "nb") / F.greatest("na", "nb") >= least).withColumn("both", F.size(F.array_intersect("sa", "sb")))
    j = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return held.withColumn("jaccard", j).where(F.col("jaccard") >= least).drop("sa", "sb", "na", "nb", "both")


def _cut(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder, so that rounds don't pile up."""
    context = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that edges (a, b) reach. Labels jump to their label's label each round."""
    links = _cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = _cut(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        near = links.join(labels, links.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        far = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        step = _cut(step.join(far, "component", "left").select("id", F.least("component", "far").alias("component"), "was"))
        labels = step.select("id", "component")
        if step.where("component <> was").isEmpty():
            return labels


def communities(edges: DataFrame, *, rounds: int = 5) -> DataFrame:
    """Weighted label propagation over edges (a, b, score): the label with the most weight around, ties to the smallest."""
    links = _cut(edges.select("a", "b", "score").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")))
    labels = links.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = links.join(labels, links.b == labels.id).groupBy("a", "label").agg(F.round(F.sum("score"), 9).alias("w"))
        labels = _cut(votes.groupBy(F.col("a").alias("id")).agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("label")))
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Q of a labelling: the weight inside labels less what chance would put there."""
    ends = edges.join(labels.withColumnsRenamed({"id": "a", "label": "la"}), "a").join(labels.withColumnsRenamed({"id": "b", "label": "lb"}), "b")
    total = edges.agg(F.sum("score")).scalar()
    inside = ends.where("la = lb").groupBy(F.col("la").alias("label")).agg(F.sum("score").alias("inside"))
    both = ends.select(F.col("la").alias("label"), "score").unionByName(ends.select(F.col("lb").alias("label"), "score")).groupBy("label").agg(F.sum("score").alias("deg"))
    held = both.join(inside, "label", "left").withColumn("m", total)
    return held.agg(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), F.lit(2.0))).alias("q"), F.count("*").alias("communities"))


def graph_nodes(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` (id, ...) with their degree in ``edges`` and their label (of a community or component), if they have one."""
    return nodes.join(degree(edges), "id", "left").join(labels.select("id", "label"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def graph_edges(edges: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``edges`` (a, b, ...) with both ends' questions and the label of the first."""
    text = lambda x: nodes.select(F.col("id").alias(x), F.col("question").alias(f"question_{x}"))
    return edges.join(text("a"), "a", "left").join(text("b"), "b", "left").join(labels.select(F.col("id").alias("a"), "label"), "a", "left")


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per category of ``nodes`` (id, category, label): nodes, labels, the size of the largest, and edges that begin there."""
    sizes = nodes.groupBy("category", "label").agg(F.count("*").alias("size"))
    out = sizes.groupBy("category").agg(F.sum("size").alias("nodes"), F.count("label").alias("labels"), F.max(F.when(F.col("label").isNotNull(), F.col("size"))).alias("largest"))
    links = edges.join(nodes.select(F.col("id").alias("a"), "category"), "a").groupBy("category").agg(F.count("*").alias("edges"))
    return out.join(links, "category", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


def top_links(edges: DataFrame, *, n: int = 8) -> DataFrame:
    """The ``n`` strongest edges (category, a, b, score) of each category, ranked."""
    best = Window.partitionBy("category").orderBy(F.desc(F.round("score", 9)), "a", "b")
    return edges.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def relation_mix(edges: DataFrame) -> DataFrame:
    """Edges of each relation, directed and not, and how many have a cosine."""
    return edges.groupBy("relation", "directed").agg(F.count("*").alias("n"), F.count("cosine").alias("n_cosine"))

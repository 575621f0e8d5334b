"""Cases of the fourth round's findings; each failed before its change."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadloom.functions.text import norm_tokens, strip_dates
from spreadloom.operators import asynccorr, blocks, positions, text


@pytest.mark.parametrize("question, stem", [("Clerk#2059 through 2026, at least 3 units", "clerk#2059 , at least 3 units"), ("Case #2031 in 2027", "case #2031"), ("Case # 2031", "case #")])
def test_a_number_behind_a_number_sign_is_no_year(spark, question, stem):
    assert spark.createDataFrame([(question,)], "q string").select(strip_dates(F.col("q"))).collect()[0][0] == stem


def _vectors(n):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 8)).round(2)
    x[n // 2 :] = x[: n - n // 2]  # equal vectors, whose cosines must be equal to the last bit
    rows = [("c" if i % 3 else "d", i, i % 5, v.tolist()) for i, v in enumerate(x)]
    odd = [("c", n, 1, None), ("c", n + 1, 2, [0.0] * 8), ("c", n + 2, 3, [1.0, 2.0]), ("c", n + 3, 4, [1.0, None, *[0.0] * 6]), (None, n + 4, 0, [1.0] * 8), ("c", n + 5, None, [1.0] * 8)]
    return rows + odd


def _cosine(x, y):
    sums = [0.0, 0.0, 0.0]
    for a, b in zip(x, y, strict=True):
        sums = [sums[0] + a * b, sums[1] + a * a, sums[2] + b * b]
    return sums[0] / (math.sqrt(sums[1]) * math.sqrt(sums[2]))


@pytest.mark.parametrize("size", [16, 4096])
def test_blocks_find_all_pairs_with_sql_s_cosines(spark, size):
    rows = _vectors(150)
    good = [r for r in rows if r[0] and r[2] is not None and r[3] and None not in r[3] and any(r[3])]
    want = {}
    for c, i, e, x in good:
        for d, j, f, y in good:
            if c == d and i < j and e != f and len(x) == len(y) and _cosine(x, y) >= 0.3:
                want[c, i, j] = _cosine(x, y)
    df = spark.createDataFrame(rows, "category string, id long, event_id long, x array<double>")
    got = blocks.compared(df, "category", least=0.3, apart=True, size=size).collect()
    assert len(got) == len(want) and {(r["category"], r["a"], r["b"]): r["cosine"] for r in got} == want
    every = {(r["a"], r["b"]): r["cosine"] for r in blocks.compared(df, "category", size=size).collect()}
    ids = [[r[1] for r in rows if r[0] == c] for c in "cd"]
    assert every.keys() == {(a, b) for x in ids for a in x for b in x if a < b} and every[1, 150] is None and every[1, 152] is None


def test_categories_of_any_size_are_compared_whole(spark):
    """Over 4,096 vectors were hashed, of which some pairs at the threshold were missed."""
    x = np.random.default_rng(6).normal(size=(4200, 6))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.triu(unit @ unit.T >= 0.97, 1) & (np.arange(4200)[:, None] % 7 != np.arange(4200) % 7)
    df = spark.createDataFrame([(1, i, i % 7, v.tolist()) for i, v in enumerate(x)], "category int, id long, event_id long, x array<double>")
    assert text.cosine_candidates(df, least=0.97).count() == near.sum()


def test_tfidf_of_blocks_equals_joined_terms(spark):
    rng = random.Random(7)
    words = "gold oil rate cut win vote bank team rise fall".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for i in range(60)] + [(60, None), (3, "gold vote gold"), (3, "oil")]
    docs = spark.createDataFrame(docs, "id long, text string")
    rows = _vectors(58)
    df = spark.createDataFrame(rows, "category string, id long, event_id long, x array<double>")
    weights = text.tfidf_vectors(docs)
    pairs = text.cosine_candidates(df, least=0.1)
    want = {(r["a"], r["b"]): r["tfidf"] for r in text.tfidf_cosine(pairs, text.tfidf_weights(docs)).collect()}
    got = {(r["a"], r["b"]): r["tfidf"] for r in text.cosine_candidates(df, least=0.1, weights=weights).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want) and 0 < sum(v > 0 for v in want.values())
    members = df.select(F.col("category").alias("cluster"), "id")
    clusters = text.cluster_edge_score(members, df, weights, least=0.2).collect()
    both = {(a, b): 0.5 * _cosine(x, y) for c, a, _, x in rows[:58] for d, b, _, y in rows[:58] if c == d and a < b}
    assert {(r["a"], r["b"]) for r in clusters if r["b"] < 58} >= {p for p, v in both.items() if v >= 0.2} and all(r["score"] >= 0.2 for r in clusters)


def test_pairs_of_large_clusters_are_dealt(spark):
    members = spark.range(9000).select(F.lit("k").alias("cluster"), "id")
    dealt = blocks.in_blocks(members, "cluster")
    assert dealt.groupBy("i", "j").count().agg(F.max("count")).first()[0] < 7000  # two blocks, where a task had the whole cluster
    pairs = text.cluster_pairs(members.where("id < 4200"))
    assert pairs.agg(F.count("*"), F.sum("a"), F.sum("b")).first() == (4200 * 4199 // 2, sum(a * (4199 - a) for a in range(4200)), sum(b * b for b in range(4200)))


def _walk(legs, holdings, balance=0.5):
    """All pairs of an event in order, each taken if both tokens are left."""
    owned = [(e, leg, o, t, size) for e, leg, yes, no in legs for o, t in (("yes", yes), ("no", no)) for h, size in holdings if h == t and size >= 1]
    pairs = []
    for e, s, so, tb, zb in owned:
        for f, g, go, ta, za in owned:
            if e == f and e is not None and s < g and so != go and min(za, zb) >= balance * max(za, zb):
                pairs.append((e, s, g, "BUY" if go == "yes" else "SELL", ta, tb, za, zb))
    out, used = [], set()
    for e, s, g, side, ta, tb, za, zb in sorted(pairs):
        if not {(e, ta), (e, tb)} & used:
            used |= {(e, ta), (e, tb)}
            out.append((e, s, g, side, ta, tb, int(min(za, zb))))
    return sorted(out)


def test_pairs_of_held_legs_equal_a_walk_over_all_pairs(spark):
    rng = random.Random(8)
    for legs_of, tokens in ((12, 40), (30, 200)):
        legs = [(e, leg, f"t{rng.randrange(tokens)}", f"t{rng.randrange(tokens)}") for e in (1, 2) for leg in range(legs_of)]
        holdings = [(f"t{rng.randrange(tokens)}", rng.choice([0.5, 1.0, 3.0, 4.5, 7.0])) for _ in range(tokens)]
        got = positions.reconcile_detect(spark.createDataFrame(legs, "event_id long, leg long, yes string, no string"), spark.createDataFrame(holdings, "token string, size double")).collect()
        assert sorted(tuple(r) for r in got) == _walk(legs, holdings) and len(got) > 3


def test_an_event_of_many_held_legs(spark):
    """Nine million pairs were gathered in one row."""
    n = 6000
    legs = spark.range(n).select(F.lit(1).alias("event_id"), F.col("id").alias("leg"), F.concat(F.lit("Y"), "id").alias("yes"), F.concat(F.lit("N"), "id").alias("no"))
    holdings = spark.range(n).select(F.concat(F.when(F.col("id") % 2 == 0, "Y").otherwise("N"), "id").alias("token"), F.lit(5.0).alias("size"))
    got = positions.reconcile_detect(legs, holdings)
    assert {(r["short_leg"], r["long_leg"]) for r in got.collect()} == {(i, i + 1) for i in range(0, n, 2)}


def test_near_duplicates_take_tokens_once_a_text(spark):
    """Tokens were taken for both texts of each pair."""
    rows = [(i, " ".join(f"w{k}" for k in range(i % 4, 21 - i % 3))) for i in range(12)] + [(12, "the 5"), (13, None)]
    q = spark.createDataFrame(rows, "id long, t string")
    texts = q.select(F.col("id").alias("a"), F.col("t").alias("ta")).crossJoin(q.select(F.col("id").alias("b"), F.col("t").alias("tb"))).where("a < b")
    tokens = texts.select("a", "b", norm_tokens(F.col("ta")).alias("sa"), norm_tokens(F.col("tb")).alias("sb"))
    found = lambda pairs: sorted((r["a"], r["b"], r["jaccard"]) for r in text.near_dup(pairs).select("a", "b", "jaccard").collect())
    sets = {i: set(t.split()) for i, t in rows[:12]}
    want = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in sets for b in sets if a < b]
    assert found(tokens) == found(texts) == sorted(w for w in want if w[2] >= 0.85)


def test_spans_shrink_where_changes_are_many(spark):
    """A task held all changes of two blocks within a span, however many those were."""
    rng = np.random.default_rng(9)
    rets = [(s, int(a), int(a) + 3, float(d)) for s in "xyz" for a, d in zip(np.sort(rng.choice(4000, 500, replace=False)), rng.normal(size=500).round(2), strict=True)]
    df = spark.createDataFrame(rets, "series string, a long, b long, d double")
    members = spark.createDataFrame([("c", s) for s in "xyz"], "cluster string, series string")
    rows = df.join(members, "series").withColumn("block", F.lit(0))
    span = asynccorr._fitting(rows, 1 << 22, 300)
    assert span < 1 << 22 and rows.groupBy(F.floor(F.col("b") / span)).count().agg(F.max("count")).first()[0] <= 300
    whole, parts = ({(r["x"], r["y"]): r["cov"] for r in asynccorr.hy_cov_clusters(df, members, span=1 << 22, most=most).collect()} for most in (10**9, 300))
    assert whole.keys() == parts.keys() and len(whole) == 3 and all(abs(whole[p] - parts[p]) < 1e-9 for p in whole)

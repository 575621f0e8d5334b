"""Centroid clustering, mixing and token alignment against brute force, on nulls, ties, repeats, long texts and no rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spreadloom.llm import alignment, centroids, mixing

DOCS = "doc_id long, text string, source string, size long, n long, `order` string, bucket string, copies string, codes string"


def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# clustering


def brute_clusters(rows, k, rounds, seed=2):
    kept = [(i, [math.floor(256 * v) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) and abs(v) < 1000 for v in x)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in kept:
            groups[near(x)[1]].append(x)
        cents = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(cents)]
    found = [(i, *near(x)) for i, x in kept]
    sums = Counter()
    for _, d, j in found:
        sums[j] += d
    return sorted((i is None, i or 0, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in found)


def clustered(df, **more):
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in centroids.report(*centroids.cluster(df, **more)).collect())


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(rng.integers(0, 3), 0.3, 64).tolist()) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(40)] + [(5, rows[5][1]), (None, rows[7][1])]  # copies, a repeated row, no id
    rows += [(500, None), (501, []), (502, [0.0] * 63), (503, [0.0] * 63 + [None]), (504, [0.0] * 63 + [float("nan")]), (505, [math.inf] + [0.0] * 63), (506, [1e30] + [0.0] * 63), (507, [0.0] * 64)]
    df = spark.createDataFrame([(i, x, 1, "c") for i, x in rows], "vec_id long, embedding array<float>, cluster int, products string")
    single = [(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x]) for i, x in rows]
    for k, rounds in ((40, 5), (3, 2), (1000, 1)):
        assert clustered(df, number=k, rounds=rounds) == brute_clusters(single, k, rounds)
    assert centroids.report(*centroids.cluster(df.where("vec_id = -1"))).count() == 0


def test_products_stay_exact_where_doubles_do_not():
    rng = np.random.default_rng(4)
    x, change = rng.integers(-(2**26), 2**26, (50, 64)), rng.integers(-(2**27), 2**27, (4, 64))
    change[:, 5:9] = 0
    assert centroids.products(x, change).tolist() == [[sum(int(a) * int(b) for a, b in zip(r, c, strict=True)) for c in change] for r in x]
    assert centroids.products(x[:3] % 7, change % 5).tolist() == ((x[:3] % 7) @ (change % 5).T).tolist()


# mixing


def wanted_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def mixed(df, **more):
    return [r.asDict() for r in mixing.mix(df, **more).collect()]


def test_mix_meets_its_targets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(3, 1.5))), rng.choice(["a", "b", "c", "é", "z", None, ""])) for i in range(1500)]
    rows += [(i, "x y z", "hot") for i in range(2000, 14_000)]  # one source, size and text, over several buckets
    rows += [(1, None, "a"), (2, "", "b"), (3, " \t\n\x0b\x0c\r", "c"), (None, "one two", "d"), (4, "q " * 300_000, "b"), (5, "a b\x1cc  ", "e"), (5, "a b\x1cc  ", "e")]
    df = spark.createDataFrame([(i, t, s, 1, 1, "o", "b", "c", "x") for i, t, s in rows], DOCS)
    got = mixed(df)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, count(t)) for i, t, s in rows)
    sizes = Counter({s: 0 for _, _, s in rows})
    for _, t, s in rows:
        sizes[s] += count(t)
    want, taken, longest = wanted_targets(sizes), Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        smallest = min((count(t) for _, t, x in rows if x == s and count(t)), default=0)
        room = 150_000 if s == "b" else smallest + 1  # copies are whole: b's text of 300,000 words is taken once or twice
        assert abs(taken[s] - want[s]) <= room, s
    key = lambda r: (r["doc_id"] or -1, str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, mixed(df.repartition(17))))
    assert mixing.mix(df.where("false")).count() == 0


def test_rates_are_tilted_by_size(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * n), "ab"[i % 2]) for i, n in enumerate(rng.choices(range(1, 60), k=6000))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixed(df, weights=(1, 4), share=1.0)
    sizes, copies = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int))
    for r in got:
        sizes[r["source"]][r["size"]] += 1
        copies[r["source"]][r["size"]] += r["copies"]
    for s in "ab":  # copies a document of each size follow min(2, exp(a * size)) for one a
        target, low, high = next(r["target"] for r in got if r["source"] == s), -5.0, 5.0
        fair = lambda a, z: min(2.0, math.exp(min(50, a * z)))  # noqa: E731, B023
        for _ in range(200):
            a = (low + high) / 2
            low, high = (a, high) if sum(n * z * fair(a, z) for z, n in sizes[s].items()) < target else (low, a)
        assert all(abs(copies[s][z] - n * fair(a, z)) <= 3 for z, n in sizes[s].items())


# alignment


def brute_alignment(rows):
    both = alignment.Aligner(*paths())
    found, counts = [], Counter()
    for i, t in rows:
        s = " " + (t or "")
        ids_a, ids_b = both.a.encode(s, add_special_tokens=False).ids, both.b.encode(t or "")
        parts_a, parts_b = [both.bytes_a[x] for x in ids_a], [both.bytes_b[x] for x in ids_b]
        if not t or b"".join(parts_a) != s.encode() or b"".join(parts_b) != s.encode():
            found.append((i, 0, 0, 0, [], ""))
            continue
        spans = []
        for parts in (parts_a, parts_b):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        a, b = spans
        said, lo = [], 0
        for cut in sorted({y for _, y in a} & {y for _, y in b}):
            inside = lambda ids, s: ",".join(str(x) for x, (u, v) in zip(ids, s, strict=True) if lo <= u and v <= cut)  # noqa: E731, B023
            said.append(f"{inside(ids_a, a)}|{inside(ids_b, b)}")
            lo = cut
        links = [(x, y) for x, (p, q) in zip(ids_a, a, strict=True) for y, (u, v) in zip(ids_b, b, strict=True) if p < v and u < q]
        counts.update(set(links))
        found.append((i, len(ids_a), len(ids_b), len(said), links, hashlib.sha256(";".join(said).encode()).hexdigest()))
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return sorted((str(i), a, b, g, len(ls), sum(counts[x] == best[x[0]] for x in ls), sum(counts[x] for x in ls), h) for i, a, b, g, ls, h in found)


def rated(df, **more):
    aligned = alignment.align(df, *paths())
    rows = alignment.rate(aligned, alignment.pair_counts(aligned, alignment.aligner(*paths()).size_b), **more).collect()
    return sorted((str(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in rows)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    pool = ["a", "the", "hello", "\n", " ", "  ", "<|endoftext|>", "<s>", "é", "ﬁ", "中文", "▁", "\t", "Über", "it's", "12.5%", "x" * 30, "😀", " ", "\x85", "\r\n", "wor", "ld", ",", "$$$", ".%%%", "<0x41>", "ع", "́", "'ll"]
    some = [rng.choice(["", " ", " ", "\n"]).join(rng.choice(pool) for _ in range(rng.randrange(0, 25))) for _ in range(400)]
    some += [" ".join(t.split()) for t in some]
    return [(i, t) for i, t in enumerate([None, "", " ", "\n", *some])] + [(None, "no id here"), (3, "the same"), (3, "the same")]


def test_alignment_equals_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t, "s", 1, 1, "o", "b", "c", "x") for i, t in texts], DOCS)
    want = brute_alignment(texts)
    assert rated(df) == want
    assert rated(df, most=10) == want  # links meet counts in a join
    assert rated(df.where("false")) == []


def test_long_texts_align_in_chunks_as_whole(spark, monkeypatch):
    rng = random.Random(8)
    text = " ".join(rng.choice(["the", "hello,", "wörld", "x1y2", "end.\nnext"]) for _ in range(3000))
    whole = alignment.Aligner(*paths())([text])[0]
    monkeypatch.setattr(alignment, "CHUNK", 500)
    monkeypatch.setattr(alignment, "CACHE_PARTS", 2)
    parts = alignment.Aligner(*paths())([text])[0]
    assert whole[:3] == parts[:3] and whole[3].tolist() == parts[3].tolist() and whole[4] == parts[4]
    huge = spark.createDataFrame([(1, "many words here " * 150_000)], "doc_id long, text string")  # over 2 MB
    assert alignment.align(huge, *paths()).first()["n_a"] == 450_001


def test_walk_jumps_and_resolves():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randrange(1, 200)
        ends = lambda share: sorted({n} | {x for x in range(1, n) if rng.random() < share})  # noqa: E731, B023
        a = ends(rng.random())
        b = sorted({n} | {x for x in a if rng.random() < 0.9} | set(ends(0.05)))
        stretches, irregular = alignment.walk(a, b)
        links = []
        for k, (i, j, m) in enumerate(stretches):
            links += [(i + x, j + x) for x in range(m)]
            links += irregular[k] if k < len(irregular) else []
        span = lambda e, i: (e[i - 1] if i else 0, e[i])
        assert links == [(i, j) for i in range(len(a)) for j in range(len(b)) if span(a, i)[0] < span(b, j)[1] and span(b, j)[0] < span(a, i)[1]]

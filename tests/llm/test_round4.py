"""Findings of the third round: what is compared or moved, with results by brute force."""

import numpy as np

from spreadloom.llm import line_dedup, minhash


def smallest_reachable(n, links):
    label = list(range(n))
    moved = True
    while moved:
        moved = False
        for i, j in links:
            low = min(label[i], label[j])
            moved |= label[i] != label[j]
            label[i] = label[j] = low
    return label


def test_a_family_of_unlike_copies_is_told_apart_without_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(40)
    base = [f"t{i}" for i in range(150)]
    edits = [f"e{i}" for i in range(3)]  # so that most edits are in several copies
    rows = []
    for i in range(600):
        w = list(base)
        for at in sorted(rng.choice(150, rng.integers(3, 9) if i else 0, replace=False), reverse=True):
            if rng.random() < 0.3:
                del w[at]
            else:
                w[at] = str(rng.choice(edits))
        rows.append((i, " ".join(w)))
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    links = [(i, j) for j in range(600) for i in range(j) if 100 * (both := len(sets[i] & sets[j])) >= 75 * (len(sets[i]) + len(sets[j]) - both)]
    want = smallest_reachable(600, links)
    counts, plain = {}, minhash.written

    def counted(df, name):
        out = plain(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(minhash, "written", counted)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(want)) and 100 < len(set(want)) < 500
    assert counts["rest"] < 5000  # every pair of a bucket that sketches and shingles of one set alone allow: 48,125


def test_ids_of_several_texts_in_a_family(spark):
    rng = np.random.default_rng(41)
    rows = []
    for i in range(80):
        w = [f"t{k}" for k in range(60)]
        for at in rng.choice(60, rng.integers(1, 6), replace=False):
            w[at] = f"e{rng.integers(4)}"
        rows.append((i % 70, " ".join(w)))  # ten ids have two texts
    sets = [(i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))) for i, w in ((i, t.split()) for i, t in rows)]
    links = [(i, j) for j, y in sets for i, x in sets if i < j and 100 * (both := len(x & y)) >= 75 * (len(x) + len(y) - both)]
    want = smallest_reachable(70, links)
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(enumerate(want)) and 5 < len(set(want)) < 65


def test_postings_are_shuffled_without_a_copy_of_themselves(spark, monkeypatch):
    plans, plain = [], line_dedup.written

    def seen(df, name):
        if name == "line_pairs":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(line_dedup, "written", seen)
    lines = ["a b c d e f g h i j", "a b c d e f g h i j k", "a b c d e f g h i j k l"]
    assert sorted(tuple(r) for r in line_dedup.removed_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).collect()) == [(1, 1), (1, 2)]
    assert "Window" in plans[0] and "struct" not in plans[0]

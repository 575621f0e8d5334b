"""Each corpus operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import gzip
import hashlib
import pathlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spreadloom.llm import decontaminate, line_dedup, minhash, nearest, packing, substring_dedup, token_files, tokens, toxicity, url_filter, warc
from spreadloom.llm.tokens import default_vocabulary

DOCS = "doc_id long, text string, n long, key string, component_id long, tokens string, `class` string"
LONG = " ".join(f"w{i}" for i in range(6000))
BASE = " ".join(f"term{i}" for i in range(60))
TEXTS = [
    (1, BASE),
    (2, BASE),
    (3, BASE.replace("term30 ", "")),
    (4, "one two three"),
    (5, "one two three"),
    (6, ""),
    (7, None),
    (8, "   \n\t "),
    (9, LONG),
    (None, BASE),
    (11, "Ünïcödé tëxt wïth\nlines\n\nand  blanks <|endoftext|> end"),
    (4, "one two three"),
    (12, BASE.upper()),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "k", 2, "t", "c") for i, t in TEXTS], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def encoded(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_words_encode_as_whole_texts(tokenizer):
    encode = tokens.WordEncoder(default_vocabulary())
    texts = [t or "" for _, t in TEXTS] + ["a  b", " a", "a ", "a\n b", "it's 12.5% of\n\n'it'", "a\x85b c", "x" * 5000, "\n", "é ²１ l'été"]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_letters_of_any_script_encode_as_whole_texts(tokenizer):
    rng = np.random.default_rng(10)
    letters = list("aeouğışñéÀÿœŒƒǆабαβאעرท漢かカ한012²½'’.,-!?()[]_\u0301\u200d😀ªº")
    texts = ["x Erdoğan y"] + [f"x {''.join(rng.choice(letters, rng.integers(1, 12)))} y" for _ in range(30_000)]
    texts += [f"a {before}{tokenizer.decode([i]).strip()}e b" for i in range(tokenizer.get_vocab_size()) for before in ("", "it")]
    got = tokens.WordEncoder(default_vocabulary())(texts)
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [t for t, g, w in zip(texts, got, want, strict=True) if g.tolist() != w.ids] == []


def test_token_files_of_extreme_ids(spark):
    docs = spark.createDataFrame([(-(2**63), "a b"), (None, "c"), (2**63 - 1, "d"), (None, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["n_tokens"]) for r in token_files.tokens_round_trip(docs, default_vocabulary()).orderBy("start").collect()]
    assert got == [(None, 1), (None, 2), (-(2**63), 3), (2**63 - 1, 2)]


def test_token_files(docs, nothing, tokenizer):
    got = [tuple(r) for r in token_files.tokens_round_trip(docs, default_vocabulary()).orderBy("start").collect()]
    want, at = [], 0
    for i, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = encoded(tokenizer, t, 0)
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.tokens_round_trip(nothing, default_vocabulary()).count() == 0


def test_packing(docs, nothing, tokenizer):
    rows = packing.pack(docs, default_vocabulary()).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(i for i, _ in TEXTS)
    for i, t in TEXTS:
        if i == 9:
            ids = encoded(tokenizer, t, 2)
            pieces = sorted((r for r in rows if r["doc_id"] == 9), key=lambda r: r["piece"])
            assert [r["start"] for r in pieces] == np.cumsum([0, *[r["length"] for r in pieces[:-1]]]).tolist()
            assert all(r["length"] == 1024 for r in pieces[1:]) and sum(r["length"] for r in pieces) == len(ids)
            assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        held.sort()
        assert [a for a, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1].tolist()] and sum(n for _, n in held) <= 1024
    assert packing.pack(nothing, default_vocabulary()).count() == 0


def test_plan_is_near_the_least_number_of_sequences():
    rng = np.random.default_rng(1)
    lengths = Counter(rng.integers(1, 1025, 5000).tolist())
    plan = packing.plan(lengths, 1024)
    assert Counter(x for items, n in plan for x in items for _ in range(n)) == lengths
    assert all(sum(items) <= 1024 for items, _ in plan)
    half = sum(n for x, n in lengths.items() if x > 512)
    assert sum(n for _, n in plan) <= max(half, -(-sum(x * n for x, n in lengths.items()) // 1024)) * 1.03


def words(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(docs, nothing):
    rows = minhash.near_duplicates(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in TEXTS)
    want = {1: 1, 2: 1, 3: 1, 12: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 9, 11: 11, None: None}
    size = {i: len(shingles(t)) for i, t in TEXTS}
    for r in rows:
        assert r["component_id"] == want[r["doc_id"]] and r["n_shingles"] == size[r["doc_id"]]
        assert r["kept"] == (None if r["doc_id"] is None else r["component_id"] == r["doc_id"])
    assert minhash.near_duplicates(nothing).count() == 0
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 6, 7, 8, 9, 11]


def test_chain_of_near_copies_is_one_component(spark):
    w = [f"v{i}" for i in range(100)]
    rows = []
    for i in range(40):
        w = [*w[:i], f"new{i}", *w[i + 1 :]]  # each differs from the one before in a word, the ends in all of 40
        rows.append((i, " ".join(w)))
    assert {r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_lines(spark, nothing):
    a, b, c = "the quick brown fox jumps over a lazy dog today", "the quick brown fox jumps over a lazy dog now today", "entirely different words stand in this line here"
    rows = [(1, f"{a}\n{c}\nshort"), (2, f"{b}\nshort\n{a}"), (3, None), (4, ""), (2, f"{b}\nshort\n{a}"), (None, a)]
    docs = spark.createDataFrame([(i, t, 1, "k", 2, "t", "c") for i, t in rows], DOCS)
    assert sorted(tuple(r) for r in line_dedup.removed_lines(docs).collect()) == [(2, 0), (2, 1), (2, 2)]
    got = line_dedup.deduplicate_lines(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in got.collect()), key=str) == sorted([(1, rows[0][1]), (2, ""), (2, ""), (3, None), (4, ""), (0, a)], key=str)
    assert line_dedup.removed_lines(nothing).count() == 0


def test_short_lines(spark, tmp_path):
    rows = [(1, "short\n\n}\ntwo words\na b c d e f"), (2, "Short\n }\n\nwords two\ntwo words more\na b c d e f g"), (3, "}\nshort short\nf")]
    docs = spark.createDataFrame([(i, t, 1, "k", 2, "t", "c") for i, t in rows], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["removed"] for r in line_dedup.query(spark, str(tmp_path)).collect()}
    assert got == {1: [], 2: [0, 1, 3, 5], 3: [0, 1]}
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert kept == {1: rows[0][1], 2: "\ntwo words more", 3: "f"}


def test_families_of_lines_by_brute_force(spark):
    rng = np.random.default_rng(16)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for n in rng.integers(7, 60, 12):
        base = list(rng.choice(vocabulary, n))
        for _ in range(40):  # variants that often are like each other, but not like the earliest
            line = [str(rng.choice(vocabulary)) if rng.random() < 0.06 else w for w in base]
            rows.append("\t ".join(line) if rng.random() < 0.1 else " ".join(line))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, "\n".join(rows[8 * i : 8 * i + 8])) for i in range(60)], "doc_id int, text string")
    sets = [set(r.split()) for r in rows]
    want = [(j // 8, j % 8) for j in range(480) if any(len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j]) for i in range(j))]
    assert 50 < len(want) < 430 and sorted(tuple(r) for r in line_dedup.removed_lines(docs).collect()) == want


def test_lines_of_clashing_columns(spark):
    names = ["id", "removed", "found", "row", "lines", "__id", "__removed", "line_no", "token", "cid"]
    docs = spark.createDataFrame([(1, "a b\nc", *names), (2, "a b\nd", *names)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    got = line_dedup.deduplicate_lines(docs)
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == [(1, "a b\nc", *names), (2, "d", *names)]


@pytest.mark.parametrize("threshold", [0.85, 0.5])
def test_short_lines_by_brute_force(spark, threshold):
    rng = np.random.default_rng(6)
    rows = [" ".join(rng.choice(list("abcdefghij"), rng.integers(1, 10), replace=False)) for _ in range(150)]
    docs = spark.createDataFrame([(i, "\n".join(rows[5 * i : 5 * i + 5])) for i in range(30)], "doc_id long, text string")
    sets = [set(r.split()) for r in rows]
    want = [(j // 5, j % 5) for j in range(150) if any(len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) for i in range(j))]
    assert sorted(tuple(r) for r in line_dedup.removed_lines(docs, threshold=threshold).collect()) == want


def repeats(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [8, 40])
def test_repeated_strings(spark, nothing, length):
    rng = np.random.default_rng(length)
    parts = ["".join(rng.choice(list("abé \n"), rng.integers(0, 5 * length))) for _ in range(12)]
    rows = [(int(i), "".join(parts[j][rng.integers(0, 9) :] for j in rng.integers(0, 12, 3))) for i in range(50)]
    rows += [(60, "a" * 4 * length), (61, "ab" * 3 * length), (60, "a" * 4 * length), (62, None), (63, ""), (None, "ab" * length)]
    docs = spark.createDataFrame([(i, t, 1, "k", 2, "t", "c") for i, t in rows], DOCS)
    got = substring_dedup.remove_repeats(docs, length=length).drop("spans").collect()
    assert sorted((tuple(r) for r in got), key=str) == repeats(rows, length)
    assert substring_dedup.remove_repeats(nothing, length=length).count() == 0


def test_warc_ignores_records_inside_payloads(spark):
    evil = "x" + gzip.compress(warc.record(99, "u", b"inner", None)).decode("latin-1")
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "c", None), (4, "d", ""), (5, "e", evil), (6, "f", "same"), (None, "g", "own"), (6, "f", "same")]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, n int")
    files = warc.write_archives(pages, level=0)
    want = []
    for i, _, html in rows:
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        data = (html or "").encode()
        first = max(same, default=None)
        want.append((i, len(data), warc.digest(data), *(("revisit", first) if first is not None and i != first else ("response", None))))
    for block in (100, 1 << 20):
        assert sorted((tuple(r) for r in warc.read_archives(files, block=block).collect()), key=str) == sorted(want, key=str)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_toxicity(spark, nothing):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(600):
        text = [f"{rng.choice(list('bcdfg'))}{rng.choice(list('aeiou'))}{rng.choice(list('lmnrs'))}{rng.choice(list('aeiou'))}" for _ in range(30)]
        if i % 3 == 0:
            text[int(rng.integers(30))] = str(rng.choice(["wretch", "vermin", "lowlife"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 3 == 0)))
    docs = spark.createDataFrame([(i, t, 1, "k", 2, "t", "c") for i, t in [*rows, (1000, None), (1001, ""), (None, "x")]], DOCS)
    model = toxicity.fit_on(docs, spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 603 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    held = [r for i, r in got.items() if i is not None and i < 600 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r["held_out"] for r in held) and np.mean([r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held]) >= 0.95
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and 350 <= kept.count() <= 450
    empty = toxicity.fit_on(nothing, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(nothing, empty).count() == 0


def test_decontamination(spark, nothing):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(20)] + [(50, None), (None, "x"), (51, "too short"), (52, "?!")]
    fill = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, fill(300)) for i in range(60)]
    for i in range(10):
        rows.append((100 + i, f"{fill(90)} {items[i][1].upper()} {fill(50)}"))
        held = items[i][1].split()
        rows.append((200 + i, f"{fill(33)} {' '.join(w if k % 4 or k > 23 else word() for k, w in enumerate(held))} {fill(20)}"))
    docs = spark.createDataFrame([(i, t, 1, "k", 2, "t", "c") for i, t in [*rows, (900, None), (901, ""), (None, items[0][1])]], DOCS)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(100 + i, i) for i in range(10)} | {(200 + i, i) for i in range(10)}
    few = spark.createDataFrame([(1, "It's too short!"), (2, "too very short"), (3, "short too"), (None, "too short")], "doc_id int, text string")
    assert [tuple(r)[:2] for r in decontaminate.contaminated(few, bench).collect()] == [(1, 51)]
    assert [tuple(r)[:2] for r in decontaminate.contaminated(few, bench.where("item_id = 51")).collect()] == [(1, 51)]
    odd = docs.select("*", *[F.lit("a").alias(c) for c in ("id", "row", "__leak", "a.b", "item_id", "words")])
    assert decontaminate.keep_clean(odd, bench).columns == odd.columns
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == 63
    assert decontaminate.contaminated(nothing, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_of_long_and_short_items(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    fill = lambda n: " ".join(word() for _ in range(n))
    items = [(0, fill(700)), (1, fill(200)), (2, fill(5)), (3, fill(5)), (4, fill(12))]
    pool = " ".join(t for _, t in items[:2]).split()
    dense = lambda n: " ".join(rng.choice(pool, n))
    half = " ".join(w if k % 3 or k > 5 else word() for k, w in enumerate(items[4][1].split()))
    often = items[2][1].split()  # of less weight than what surrounds them
    rows = [(i, f"{fill(200)} {often[i % 5]}") for i in range(30)] + [(100, f"{fill(41)} {items[0][1]} {fill(90)}"), (101, f"{fill(70)} {items[1][1]} {fill(9)}")]
    rows += [(102, f"{dense(150)} {items[2][1]} {dense(110)}"), (103, f"{dense(90)} {items[3][1]} {dense(150)}"), (104, f"{dense(77)} {half} {dense(150)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for some in (256, 6):  # one block and several
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench, items=some).collect()} == {(100 + i, i) for i in range(5)}


def test_blocks_of_a_benchmark_share_a_pass(spark, monkeypatch):
    rng = np.random.default_rng(11)
    fill = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    items = [(i, fill(30)) for i in range(24)] + [(24, fill(3))]
    rows = [(i, f"{fill(80)} {t} {fill(40)}") for i, t in items] + [(100 + i, fill(120)) for i in range(10)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    passes, encode = [], decontaminate.sequences
    monkeypatch.setattr(decontaminate, "sequences", lambda *a: passes.append(1) or encode(*a))
    leaks = lambda: {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench, items=5).collect()}
    assert leaks() == {(i, i) for i in range(25)} and len(passes) == 1  # 5 blocks
    monkeypatch.setattr(decontaminate, "SHARED", 2)
    assert leaks() == {(i, i) for i in range(25)} and len(passes) == 4


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 8)).round(2).astype(np.float32)
    x[50:120] = x[50]  # a vector that many ids share
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1020, [0.0] * 8, 1), (1040, [float("nan")] * 8, 1), (1060, [None] * 8, 1), (None, x[0].tolist(), 1), (60, x[60].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in nearest.nearest(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        s = x.astype(float) @ x[q].astype(float)
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(v - s[i]) < 1e-9 for _, i, v in found)
        hits += len(set(want) & {i for _, i, _ in found})
    assert hits >= 0.9 * 20 * len(got)
    assert nearest.nearest(df.limit(0)).count() == 0 and nearest.nearest(df.where("vec_id in (20, 21)")).count() == 1


def test_nearest_of_mixed_lengths(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((5000, 16))
    x *= (np.exp(rng.normal(0, 1, 5000)) / np.linalg.norm(x, axis=1))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.nearest(df, every=50).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 5000, 50):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.95 * 20 * 100


def test_nearest_of_outliers(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((900, 8)) * 0.05
    x[:, 0] += 1
    x[::60] = np.eye(8)[rng.integers(1, 8, 15)] + rng.standard_normal((15, 8)) * 1e-6  # alone or nearly so
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, v.tolist()) for v in np.roll(x[:40], 3, 1)]  # an id of many vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for some, n in ((df, 20), (df.where("vec_id < 12"), 11)):
        got = {r["query_id"]: r["n"] for r in nearest.nearest(some).groupBy("query_id").count().withColumnRenamed("count", "n").collect()}
        assert got == {r["vec_id"]: n for r in some.where("vec_id % 20 = 0").distinct().select("vec_id").distinct().collect()}


def test_url_rules(spark):
    rows = [(1, "http://A.Example.com/en/7?x"), (2, "https://x.com/en/1"), (3, "ftp://net/de/8"), (4, "http://m.example.net/de/81#a"), (5, "no scheme.com/en/"), (6, None), (7, "http://xcom/en/1"), (8, "http://org/es/"), (9, "://"), (1, "http://com/fr")]
    pages = spark.createDataFrame([(*r, "v", "k") for r in rows], "page_id long, url string, verdict string, key string")
    got = [tuple(r) for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark)).collect()]
    want = [(1, "example.com/en/7", "allow"), (1, "", "allow"), (2, "com/en/", "block"), (3, "net/de/", "allow"), (4, "example.net/de/8", "block"), (5, "", "allow"), (6, "", "allow"), (7, "", "allow"), (8, "org/es/", "block"), (9, "", "allow")]
    assert sorted((r[0], r[3] or "", r[4]) for r in got) == sorted(want)
    assert {r[0]: (r[1], r[2]) for r in got}[4] == ("m.example.net", "/de/81") and {r[0]: r[1] for r in got}[6] == ""
    assert url_filter.filter_urls(pages, url_filter.rules_frame(spark, [("block", "a", "/")]).limit(0)).where("verdict <> 'allow'").count() == 0
    many = [("block", f"h{i}.com", f"/{'p' * (i % 3)}") for i in range(3000)]
    urls = spark.createDataFrame([(i, f"http://www.h{i}.com/ppp") for i in range(0, 6000, 7)], "page_id long, url string")
    blocked = {r["page_id"] for r in url_filter.filter_urls(urls, url_filter.rules_frame(spark, many)).where("verdict = 'block'").collect()}
    assert blocked == set(range(0, 3000, 7))


def test_decontamination_folds_letters_of_all_scripts(spark):
    item = "l'été où l'école fermée à côté du château brûlé était déjà oubliée par ses élèves"
    fill = " ".join(f"wort{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{fill} {item.upper()} {fill}"), (2, fill), (3, item.title())], "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in found.select("doc_id").distinct().collect()) == [1, 3]


def test_stages_delete_what_the_stages_before_wrote(spark, docs):
    common = minhash.written.__globals__
    first = common["tidy"](lambda spark, docs, d: common["written"](docs, "one"))
    made = first(spark, docs, "")
    folder = made.inputFiles()[0].rpartition("/")[0].rpartition(":")[2]
    rows = made.count()
    lazy = common["tidy"](lambda spark, docs, d: docs)(spark, made, "")  # still reads it
    assert lazy.count() == rows and pathlib.Path(folder).exists()
    common["tidy"](lambda spark, docs, d: docs)(spark, docs, "")
    assert not pathlib.Path(folder).exists()


def test_every_word_is_in_a_window():
    for n in range(1, 30):
        words = [f"w{i}" for i in range(n)]
        found = [w.decode().split() for w in toxicity.windows(" ".join(words))]
        assert {x for w in found for x in w} == {*words} and all(len(w) == min(n, toxicity.WINDOW) for w in found)
    assert toxicity.windows("") == toxicity.windows(" \n") == []


def test_a_telling_last_word_counts():
    rng = np.random.default_rng(13)
    plain = lambda n: " ".join(f"{rng.choice(list('bcdfg'))}{rng.choice(list('aeiou'))}{rng.choice(list('lmnrs'))}{rng.choice(list('aeiou'))}" for _ in range(n))
    texts = [f"{plain(20)} wretch {plain(9)}" if i % 3 == 0 else plain(30) for i in range(600)]
    model = toxicity.fit(texts, [int(i % 3 == 0) for i in range(600)], [*range(600)])
    scorer = toxicity.Scorer(model)
    for n in (26, 27, 28, 29, 30):
        text = plain(n)
        assert scorer.score(f"{text} wretch") > 0.5 > scorer.score(f"{text} {plain(1)}")


def test_pipeline_stages(spark, tmp_path, tokenizer):
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("bcdfglmnrstaeiou"), 5))
    fill = lambda n: " ".join(word() for _ in range(n))
    item, near, line = fill(30), fill(60), fill(12)
    plain = lambda: [f"{rng.choice(list('bcdfg'))}{rng.choice(list('aeiou'))}{rng.choice(list('lmnrs'))}{rng.choice(list('aeiou'))}" for _ in range(30)]
    rows = [(i, " ".join(["wretch" if i % 3 == 0 and k == i % 30 else w for k, w in enumerate(plain())])) for i in range(600)]
    cut = lambda n, end=60: " ".join(near.split()[:n]) + "\n" + " ".join(near.split()[n:end])  # noqa: E731  lines unlike each other
    rows += [(900, cut(30)), (901, cut(20)), (902, cut(10, 59)), (903, f"{fill(40)} {item} {fill(9)}"), (904, f"{line}\n{fill(30)}"), (905, f"{line}\n{fill(30)}"), (906, None), (907, ""), (None, fill(20)), (908, fill(30)), (908, fill(30))]
    names = ["id", "row", "found", "removed", "label", "__leak", "key", "class", "words", "score"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    spark.createDataFrame([(i, t, "en", "s", 1, *names) for i, t in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        kept[name] = docs.collect()
        assert name == "best_fit_packing" or docs.columns == columns
    ids = {n: Counter(r["doc_id"] for r in k) for n, k in kept.items()}
    toxic, clean = {i for i in range(600) if i % 3 == 0}, {i for i in range(600) if i % 3}
    assert len(toxic & set(ids["toxicity"])) <= 10 and len(clean - set(ids["toxicity"] )) <= 10 and {906, 907, None} <= set(ids["toxicity"])
    texts = {r["doc_id"]: r["text"] for r in kept["line_dedup"]}
    assert ids["line_dedup"] == ids["toxicity"] and line in texts[904] and line not in texts[905] and texts[906] is None
    assert not {901, 902} & set(ids["minhash_dedup"]) and {900, 906, 907, None} <= set(ids["minhash_dedup"]) and ids["minhash_dedup"][908] == 1
    assert ids["minhash_dedup"] - ids["decontamination"] == Counter({903: 1})
    last = {r["doc_id"]: r["text"] for r in kept["decontamination"]}
    for r in kept["best_fit_packing"]:
        want = encoded(tokenizer, last[r["doc_id"]], 2)
        assert r["ids_crc32"] == zlib.crc32(want[r["start"] : r["start"] + r["length"]].tobytes())
    assert ids["best_fit_packing"] == ids["decontamination"]
    empty = docs.sparkSession.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0

"""Small hand-made cases of the ladder engine."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from spreadloom.functions.text import deadline, norm_tokens, strip_dates, strip_thresholds
from spreadloom.operators import asynccorr, book, flow, positions, research, spread, text, trades, universe
from spreadloom.sources import files

KEYS = ["event_id", "short_dd", "long_dd"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def replay(spark, signals, marks):
    s = frame(spark, [("e", "a", "b", *r) for r in signals], "event_id string, short_dd string, long_dd string, bar long, direction string, spread double")
    m = frame(spark, [("e", "a", "b", *r) for r in marks], "event_id string, short_dd string, long_dd string, bar long, spread double")
    return positions.ledger_replay(s, m, keys=KEYS, cost_c=2.0)


def test_ledger_opens_once_closes_late_and_reopens(spark):
    got = replay(spark, [(0, "SELL", 0.40), (5, "SELL", 0.90), (30, "BUY", 0.10)], [(10, 0.35), (24, 0.30), (60, 0.15)]).orderBy("entry_bar").collect()
    assert [(r["entry_bar"], r["exit_bar"], r["pnl_c"], r["status"]) for r in got] == [(0, 24, 8.0, "closed"), (30, 60, 3.0, "closed")]
    assert replay(spark, [(0, "BUY", 0.1)], [(23, 0.5)]).collect()[0]["status"] == "open"


def test_ledger_summary(spark):
    s = positions.ledger_summary(frame(spark, [("closed", 8.0), ("closed", -3.0), ("open", None)], "status string, pnl_c double")).collect()[0]
    assert (s["n"], s["n_open"], s["total"], s["mean"], s["hit"]) == (2, 1, 5.0, 2.5, 0.5)


def test_marks_come_before_signals_of_a_bar(spark):
    got = replay(spark, [(0, "BUY", 0.1), (24, "BUY", 0.2)], [(24, 0.2), (48, 0.3)]).orderBy("entry_bar").collect()
    assert [(r["entry_bar"], r["exit_bar"]) for r in got] == [(0, 24), (24, 48)]


@pytest.mark.parametrize(
    "held, want",
    [
        ([("N2", 234.0), ("Y1", 251.0)], [("SELL", 234)]),
        ([("Y2", 100.0), ("N1", 120.0)], [("BUY", 100)]),
        ([("Y2", 100.0), ("Y1", 100.0)], []),
        ([("Y2", 100.0)], []),
        ([("Y2", 1.3), ("N1", 92.0)], []),
        ([("Y2", 100.0), ("Y3", 100.0), ("N1", 100.0)], [("BUY", 100)]),
    ],
)
def test_reconcile(spark, held, want):
    legs = frame(spark, [("e", i, f"Y{i}", f"N{i}") for i in (1, 2, 3)], "event_id string, leg int, yes string, no string")
    got = positions.reconcile_detect(legs, frame(spark, held, "token string, size double")).collect()
    assert [(r["direction"], r["shares"]) for r in got] == want


def test_reconcile_plan(spark):
    key = "event_id string, direction string"
    plan = positions.reconcile_plan(frame(spark, [("a", "BUY"), ("b", "BUY")], key), frame(spark, [("b", "BUY"), ("c", "SELL")], key), ["event_id", "direction"])
    assert sorted((r["event_id"], r["action"]) for r in plan.collect()) == [("a", "adopt"), ("c", "drop")]


def test_loss_per_share_and_totals(spark):
    p = frame(spark, [("e", "BUY", 0.1, 100.0), ("e", "SELL", 0.1, 50.0), ("f", "BUY", -0.2, 10.0), ("f", "SELL", 1.4, 10.0)], "event_id string, direction string, entry_spread double, shares double")
    each = [round(r[0], 6) for r in p.select(positions.wcl_per_share(F.col("direction"), F.col("entry_spread"))).collect()]
    assert each == [0.1, 0.9, 0.0, 0.0]
    assert {r["event_id"]: round(r["wcl"], 6) for r in positions.open_wcl(p, "event_id").collect()} == {"e": 55.0, "f": 0.0}


def test_walk_by_depth_and_caps(spark):
    levels = [("L", "ask", 0.5, 100_000.0), ("L", "bid", 0.49, 100_000.0), ("S", "ask", 0.41, 100_000.0), ("S", "bid", 0.4, 100_000.0)]
    b = frame(spark, levels, "token string, side string, price double, size double")
    pair = frame(spark, [(1, "BUY", "L", "S", 0.3)], "id int, direction string, long_token string, short_token string, mu double")
    assert book.book_walk(pair, b, max_dollars=1e9, max_shares=1e9).collect()[0]["shares"] == 50_000
    assert book.book_walk(pair, b, max_dollars=1e9, max_shares=500.0).collect()[0]["shares"] == 500
    assert book.book_walk(pair, b, max_dollars=1e9, max_shares=9.0).count() == 0


def test_positions_add_up(spark):
    clips = frame(spark, [("e", "BUY", 100.0, 0.1, 5), ("e", "BUY", 100.0, 0.2, 3), ("e", "SELL", 50.0, 0.3, 4)], "event_id string, direction string, shares double, spread double, day int")
    got = {r["direction"]: (r["shares"], round(r["entry_spread"], 9), r["first_day"], r["n_adds"]) for r in positions.accumulate_positions(clips).collect()}
    assert got == {"BUY": (200.0, 0.15, 3, 2), "SELL": (50.0, 0.3, 4, 1)}


def spreads(spark, values):
    return frame(spark, [("e", "a", "b", i, v) for i, v in enumerate(values)], "event_id string, short_dd string, long_dd string, bar long, spread double")


def test_statistics_do_not_look_ahead(spark):
    values = [0.1, 0.12, 0.09, 0.3, 0.1, 0.11, 0.5, 0.2]
    z = lambda v: [r["z"] for r in spread.rolling_z(spreads(spark, v), window=4, min_obs=2).orderBy("bar").collect()]
    assert z(values)[:6] == z(values[:6]) and z(values)[1] is None
    assert z([0.2] * 5) == [None] * 5


def test_pairs_are_ordered_and_complete(spark):
    panel = frame(spark, [("e", o, f"L{o}", 1, 0.1 * o) for o in range(4)], "event_id string, ladder_order int, ladder_label string, bar long, p double")
    got = spread.spread_panel(panel).collect()
    assert len(got) == 6 and all(r["short_dd"] < r["long_dd"] and r["spread"] > 0 for r in got)


def test_cooldown_keeps_the_first_and_what_follows_its_end(spark):
    t = frame(spark, [("e", "a", "b", s, x, "BUY") for s, x in ((1, 5), (10, 12), (29, 30), (28, 40))], "event_id string, short_dd string, long_dd string, signal_bar long, exit_bar long, direction string")
    assert sorted(r["signal_bar"] for r in trades.cooldown_fold(t, cooldown=24).collect()) == [1, 29]


def test_nonoverlap_holds_h_bars_and_the_entry_bar(spark):
    g = frame(spark, [("e", "a", "b", 3, 24, b, 2.5, 0.1) for b in (1, 2, 3, 4, 9)], "event_id string, short_dd string, long_dd string, h int, w int, bar long, z double, fwd double")
    assert sorted(r["bar"] for r in research.nonoverlap_pair(g, z=2.0).collect()) == [1, 9]


@pytest.mark.parametrize(
    "question, want",
    [("Will it end by March 31, 2026?", dt.date(2026, 3, 31)), ("Will it end by Feb 3?", dt.date(2024, 2, 3)), ("Will it end by January 2?", dt.date(2025, 1, 2)), ("Will it end in 2027?", dt.date(2027, 12, 31)), ("Will it end before 2027?", dt.date(2026, 12, 31)), ("Will it end by Smarch 31, 2026?", None), ("Will it end?", None), ("Will it end by February 29, 2026?", None), ("Will it end by Feb 29?", dt.date(2024, 2, 29))],
)
def test_deadlines(spark, question, want):
    df = frame(spark, [(question,)], "q string")
    assert df.select(deadline(F.col("q"), F.lit("2024-01-15").cast("date"))).collect()[0][0] == want


@pytest.mark.parametrize(
    "question, stem",
    [
        ("Will Gold reach at least $1,200.50k by December 31, 2025?", "will gold reach"),
        ("Will the market decide on a novel marathon?", "will the market decide on a novel marathon"),
        ("$5000 in 1999 shares", "in 1999 shares"),
        ("Closed by March 31st, 2026", "closed"),
        ("Revenue in Q1 2025 above 3 million", "revenue"),
        ("Landing on 3/15/2026 or after May?", "landing or"),
        ("Omar at 12,2027 until", "omar at 12,2027"),
        ("GDP under 2.5%,", "gdp"),
        ("", ""),
    ],
)
def test_stems(spark, question, stem):
    assert frame(spark, [(question,)], "q string").select(strip_thresholds(strip_dates(F.col("q")))).collect()[0][0] == stem


def test_tokens(spark):
    tokens = lambda t: frame(spark, [(t,)], "q string").select(norm_tokens(F.col("q"))).collect()[0][0]
    assert tokens("Will the GPT-5 (High) beat “1550”, or not?") == ["gpt-5", "beat", "not"]
    assert tokens("‘It’s’ 12,000.5 - (a) beat beat") == ["it's", "beat"] and tokens("the 5?") == []


def test_loss_budget_takes_only_what_it_uses(spark):
    plans = lambda *rows: frame(spark, [(1, i, e, n, w) for i, (e, n, w) in enumerate(rows)], "snapshot int, seq int, event_id string, shares double, loss double")
    take = lambda df, **o: [(r["event_id"], r["shares"], round(r["wcl"], 6)) for r in book.loss_budget(df, **o).orderBy("seq").collect()]
    # the first plan is cut to the event's budget, the second finds nothing left in it, the third is another event's
    assert take(plans(("e", 1000.0, 0.5), ("e", 100.0, 0.5), ("f", 600.0, 0.5)), total=600.0, per_event=450.0) == [("e", 900, 450.0), ("f", 300, 150.0)]
    # a refused plan uses up nothing
    assert take(plans(("e", 9.0, 50.0), ("e", 100.0, 0.5)), total=600.0, per_event=450.0) == [("e", 100, 50.0)]
    assert take(plans(("e", 30.0, 0.0),), total=10.0, per_event=10.0) == [("e", 30, 0.0)]


def test_exits_look_ahead_within_the_hold(spark):
    rows = [("e", "a", "b", i, 0.1 * i, 0.2, z) for i, z in enumerate([-2.0, -1.0, -0.5, 0.1, 0.2, -3.0, None])]
    stats = frame(spark, rows, "event_id string, short_dd string, long_dd string, bar long, p_short double, p_long double, z double")
    picked = trades.with_exits(stats, max_hold=3).where("bar in (0, 1, 2, 5, 6)").withColumn("direction", F.lit("BUY"))
    got = {r["signal_bar"]: (r["entry_rn"], r["exit_rn"], r["status"]) for r in trades.trade_exit(picked, max_hold=3).collect()}
    assert got == {0: (2, 4, "Z"), 1: (3, 4, "Z"), 2: (4, 5, "Z"), 5: (7, 7, "P")}
    sold = trades.with_exits(stats, max_hold=1).where("bar = 2").withColumn("direction", F.lit("SELL"))
    assert [(r["exit_rn"], r["status"]) for r in trades.trade_exit(sold, max_hold=1).collect()] == [(5, "T")]


def test_communities_and_modularity(spark):
    clique = lambda xs: [(a, b, 1.0) for i, a in enumerate(xs) for b in xs[i + 1 :]]
    edges = frame(spark, [*clique([1, 2, 3, 4]), *clique([11, 12, 13, 14]), (4, 11, 0.1)], "a long, b long, score double")
    labels = text.communities(edges)
    got = {r["id"]: r["label"] for r in labels.collect()}
    assert len({got[i] for i in (1, 2, 3, 4)}) == 1 and len({got[i] for i in (11, 12, 13, 14)}) == 1 and got[1] != got[11]
    q = text.modularity(edges, labels).collect()[0]
    inside, total = 12.0, 12.1  # each clique has half of all ends
    assert q["communities"] == 2 and abs(q["q"] - (inside / total - 2 * 0.25)) < 1e-9


def test_explained_variance_of_a_cluster(spark):
    import numpy as np

    c = np.array([[1.0, 0.8, 0.1], [0.8, 1.0, 0.2], [0.1, 0.2, 1.0]])
    rows = [("k", x, y, float(c[i, j])) for i, x in enumerate("abc") for j, y in enumerate("abc") if i < j]
    got = {r["series"]: r["r2"] for r in asynccorr.loo_r2(frame(spark, rows, "cluster string, x string, y string, rho double")).collect()}
    want = 1 - 1 / np.diag(np.linalg.inv(0.9 * c + 0.1 * np.eye(3)))
    assert all(abs(got[n] - w) < 1e-9 for n, w in zip("abc", want))
    with pytest.raises(Exception, match="at most 2"):
        asynccorr.loo_r2(frame(spark, rows, "cluster string, x string, y string, rho double"), most=2).collect()


def test_typed_edges(spark):
    rows = [("g", 1, "implies", "2", 0), ("g", 2, "implies", None, 1), ("g", 3, "implies", "1", 2), ("h", 8, "same", "2", 1), ("h", 7, "same", "1", 0), ("i", 9, "implies", "1", 0)]
    members = frame(spark, [(g, i, r, k, n) for g, i, r, k, n in rows], "`group` string, id int, relation string, rank string, seq int")
    cosines = frame(spark, [(1, 3, 0.5)], "a int, b int, cosine double")
    got = sorted((r["source"], r["target"], r["directed"], r["cosine"]) for r in text.typed_edges(members, cosines).collect())
    assert got == [(1, 2, True, None), (3, 1, True, 0.5), (3, 2, True, None), (7, 8, False, None)]


def test_events_explode_with_their_gaps(spark):
    schema = "id int, title string, tags array<struct<slug:string,label:string>>, volume string, liquidity string, markets array<struct<id:int,slug:string,question:string,description:string,endDate:string,outcomes:string,clobTokenIds:string,outcomePrices:string,volume:string,liquidity:string,spread:string,negRisk:boolean,orderPriceMinTickSize:string>>"
    market = lambda i, q, prices: (i, f"s{i}", q, " c ", "2026-01-05T00:00:00Z", '["Yes","No"]', f'["A{i}","B{i}"]', prices, "x", None, "0.02", None, None)
    events = [
        (1, "Done by when", [("A", "x"), (None, "Bee"), (None, None)], "10", None, [market(1, "Done by May 3, 2026?", '["1","0"]'), market(2, "Done by May 3, 2026?", "[]"), market(3, "Done by June 3, 2026?", None), market(4, "A vs B by May?", None)]),
        (2, "Red vs Blue by May", [], None, None, [market(5, "Done by May 3, 2026?", None), market(6, "Done by June 3, 2026?", None)]),
        (3, "By one date", None, None, None, [market(7, "Done by May 3, 2026?", None)]),
    ]
    got = universe.universe_build(frame(spark, events, schema), F.lit("2026-01-01").cast("date")).orderBy("ladder_order").collect()
    assert [(r["event_id"], r["market_id"], r["ladder_label"], r["resolution"], r["tags"], r["market_volume"], r["market_spread"], r["neg_risk"], r["min_tick"]) for r in got] == [(1, 2, "2026-05-03", None, "a,bee", None, 0.02, False, 0.01), (1, 3, "2026-06-03", None, "a,bee", None, 0.02, False, 0.01)]


def test_hayashi_yoshida_equals_all_overlaps(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(s, int(t), k, round(float(p), 3)) for s in "xy" for k, (t, p) in enumerate(zip(np.sort(rng.choice(500, 80, replace=False)), rng.random(80)))]
    rets = asynccorr.returns(asynccorr.change_points(frame(spark, rows, "series string, t long, seq int, p double")))
    r = rets.toPandas()
    x, y = r[r.series == "x"], r[r.series == "y"]
    want = sum(i.d * j.d for i in x.itertuples() for j in y.itertuples() if j.b > i.a and j.a < i.b)
    got = asynccorr.hy_cov(rets, frame(spark, [("x", "y")], "x string, y string")).collect()[0]["cov"]
    assert abs(got - want) < 1e-9


def test_components_of_a_long_chain(spark):
    edges = frame(spark, [(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["component"] for r in text.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_logs_decode(spark):
    word = lambda n: f"{n:064x}"
    data = "0x" + word(0) + word(7) + word(5_000_000) + word(10_000_000) + word(1000)
    logs = frame(spark, [("0x10", "t", ["0x1", "0x2", "0x" + word(0xAB), "0x" + word(9)], data), ("0x11", "u", ["0x1", "0x2", "0x" + word(1), "0x" + word(8)], data)], "block string, tx string, topics array<string>, data string")
    got = flow.chainlog_decode(logs, "0x" + word(9)).collect()
    assert [(r["block"], r["side"], r["tokens"], r["usdc"], r["price"], r["fee"]) for r in got] == [(16, "BUY", 10.0, 5.0, 0.5, 0.001)]


def test_files(spark, tmp_path):
    (tmp_path / "ledger.jsonl").write_text('{"event_id":"e","entry_spread":0.1,"status":"open"}\n\nnot json\n{"event_id":"f","status":"closed"}\n')
    assert sorted(r["event_id"] for r in files.ledger_read(spark, str(tmp_path / "ledger.jsonl")).collect()) == ["e", "f"]
    (tmp_path / "metals.csv").write_text('underlying_a, underlying_b,sign,strength,why\n"u1", u2 ,+1,high,"both rise, mostly"\n\nu3,u4,-\n')
    got = files.pairs_ragged_csv(spark, str(tmp_path / "metals.csv")).orderBy("underlying_a").collect()
    assert [(r["underlying_a"], r["underlying_b"], r["sign_value"], r["rationale"], r["category"]) for r in got] == [("u1", "u2", 1, "both rise, mostly", "metals"), ("u3", "u4", -1, "", "metals")]
    rows = frame(spark, [("x", 1), ("y", 2), ("y", 3)], "category string, v int")
    files.category_export(rows, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["category=x", "category=y"]
    assert sorted(r["v"] for r in files.trades_sink(rows, str(tmp_path / "trades")).collect()) == [1, 2, 3]


def test_walk_with_fees_loss_cap_and_ratio(spark):
    levels = [("L", "ask", 0.5, 1e5), ("L", "bid", 0.49, 1e5), ("S", "ask", 0.41, 1e5), ("S", "bid", 0.4, 1e5)]
    b = frame(spark, levels, "token string, side string, price double, size double")
    key = "id int, direction string, long_token string, short_token string, mu double, spread double, wcl_budget double, fee_rate_long double, fee_exp_long double, fee_rate_short double, fee_exp_short double"
    rows = [(1, "BUY", "L", "S", 0.3, 0.1, 5.0, 0.0, 1.0, 0.0, 1.0), (2, "SELL", "L", "S", -0.3, 0.1, 45.0, 0.0, 1.0, 0.0, 1.0), (3, "BUY", "L", "S", 0.3, None, None, 0.1, 1.0, 0.1, 1.0), (4, "BUY", "L", "S", 0.14, None, None, 0.1, 1.0, 0.1, 1.0)]
    walk = lambda **o: {r["id"]: (r["shares"], round(r["avg_edge"], 6)) for r in book.book_walk(frame(spark, rows, key), b, **o).collect()}
    assert walk(max_dollars=1e9, max_shares=1e9) == {1: (50, 0.2), 2: (50, 0.38), 3: (50_000, 0.151)}
    assert set(walk(max_dollars=1e9, ratio=2.0)) == {1, 2, 3} and set(walk(max_dollars=1e9, ratio=2.5)) == {1, 2}
    left, taken = 110.0, 0.0  # the reference's loop on one rung
    while left / 1.149 >= 1:
        taken, left = taken + left / 1.149, left - left / 1.149 * 1.1
    assert walk(max_dollars=110.0)[3][0] == int(taken)


def test_hashed_candidates_find_what_brute_force_finds(spark):
    import numpy as np

    rng = np.random.default_rng(1)

    def made(n):
        centres = rng.normal(size=(n // 20, 24))
        x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, 24)) * 0.6
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    met = {}
    for n in (1500, 3000):
        x = made(n)
        df = frame(spark, [("c", i, i % 7, v.tolist()) for i, v in enumerate(x)], "category string, id long, event_id long, x array<double>")
        cos = x @ x.T
        want = {(i, j) for i, j in zip(*np.nonzero(np.triu(cos, 1) >= 0.7), strict=True) if i % 7 != j % 7}
        got = text.cosine_candidates(df, least=0.7, few=1000).collect()
        found = {(r["a"], r["b"]) for r in got}
        assert len(got) == len(found) and found <= want and len(found) >= 0.95 * len(want) and all(abs(r["cosine"] - cos[r["a"], r["b"]]) < 1e-9 for r in got)
        assert {(r["a"], r["b"]) for r in text.cosine_candidates(df, least=0.7).collect()} == want  # few enough for all pairs
        bits = F.lit(int(np.log2(n / text.BUCKET)))
        met[n] = text.lsh_pairs(df.withColumn("bits", bits), least=0.7, recall=0.99).count()
    assert met[3000] < 3.5 * met[1500] and met[3000] < 3000 * 3000 / 4  # fewer than all pairs, and growing less than their number


def test_matrices_of_clusters_equal_all_overlaps(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rets, brute = [], {}
    for k in range(9):
        ends = np.unique(rng.integers(0, 5000, 120)).tolist()
        rets += [(f"s{k}", a, b, float(d)) for a, b, d in zip(ends, ends[1:], rng.normal(size=len(ends) - 1).round(3), strict=False)]
    member = {f"s{k}": "one" if k < 7 else "two" for k in range(9)}
    for x, a, b, d in rets:
        for y, e, f, g in rets:
            if x < y and member[x] == member[y] and e < b and f > a:
                brute[x, y] = brute.get((x, y), 0.0) + d * g
    df = frame(spark, rets, "series string, a long, b long, d double")
    members = frame(spark, [(c, x) for x, c in member.items()], "cluster string, series string")
    for block, span in ((2, 700), (32, 10_000), (3, 1)):
        got = {(r["x"], r["y"]): r["cov"] for r in asynccorr.hy_cov_clusters(df, members, block=block, span=span).collect()}
        assert got.keys() == brute.keys() and all(abs(got[p] - brute[p]) < 1e-9 for p in brute)


def test_cluster_report_names_clusters(spark):
    r2 = frame(spark, [("c", "a", 0.1), ("c", "b", 0.3), ("c", "d", 0.2), ("e", "f", 0.5)], "cluster string, series string, r2 double")
    members = frame(spark, [("c", "a", "x", "the gold price 5"), ("c", "b", "y", "gold price of oil"), ("c", "d", "y", "gold in 12.5 oz"), ("e", "f", "z", "an")], "cluster string, series string, category string, stem string")
    got = {r["cluster"]: (r["n"], r["median_r2"], r["max_r2"], r["category"], r["label"]) for r in asynccorr.cluster_report(r2, members).collect()}
    assert got == {"c": (3, 0.2, 0.3, "y", "gold price oil"), "e": (1, 0.5, 0.5, "z", None)}

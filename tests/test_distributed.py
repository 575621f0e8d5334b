"""Folds, as-of joins, percentiles, readers and ladders that are split over tasks, against plain Python."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadloom.operators import book, flow, positions, quantiles, signals, trades
from spreadloom.sources import files


def test_greedy_equals_a_walk_whatever_the_blocks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(0, 900), rng.choice([None, *range(-3, 40)]), i) for i in range(3000)]
    rows += [("z", None, 3, 5000), ("z", 5, None, 5001), ("z", 5, None, 5002)]
    df = spark.createDataFrame(rows, "k string, t long, hold long, id long")
    want, last = [], {}
    for k, t, hold, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1], r[3])):
        if k not in last or last[k] is None or t >= last[k]:
            want.append(i)
            last[k] = None if hold is None else t + hold
    for block in (3, 256):
        got = trades.greedy(df, ["k"], start="t", free=F.col("t") + F.col("hold"), order=["id"], block=block)
        assert sorted(r["id"] for r in got.collect()) == sorted(want) and got.columns == df.columns
    assert trades.greedy(df.where("false"), ["k"], start="t", free=F.col("hold")).count() == 0


def test_greedy_of_one_hot_key(spark):
    big = spark.range(100_000).select(F.lit("k").alias("k"), F.col("id").alias("t"), (F.col("id") * 7 % 5 + 1).alias("hold"))
    kept, free = 0, 0
    for t in range(100_000):
        if t >= free:
            kept, free = kept + 1, t + t * 7 % 5 + 1
    assert trades.greedy(big, ["k"], start="t", free=F.col("t") + F.col("hold")).count() == kept


@pytest.mark.parametrize("hold", [0, 5])
def test_ledger_equals_a_walk_over_signals_and_marks(spark, hold):
    rng = random.Random(2)
    events = [("k", b, 1, rng.choice(["BUY", "SELL"]), rng.random()) for b in rng.sample(range(200), 60)] + [("k", b, 0, None, rng.random()) for b in rng.sample(range(200), 50)]
    df = spark.createDataFrame(events, "key string, bar long, kind int, direction string, spread double")
    done, now = [], None
    for _, bar, kind, side, spread in sorted(events, key=lambda e: (e[1], e[2])):
        if kind and now is None:
            now = (bar, side, spread)
        elif not kind and now and bar - now[0] >= hold:
            done.append((*now, bar, spread))
            now = None
    want = [*done, (*now, None, None)] if now else done
    got = positions.ledger_replay(df.where("kind = 1").drop("kind"), df.where("kind = 0").select("key", "bar", "spread"), keys=["key"], hold=hold).collect()
    assert sorted((r["entry_bar"], r["direction"], r["entry_spread"], r["exit_bar"], r["exit_spread"]) for r in got) == sorted(want, key=lambda r: r[0])


def test_block_times_over_ranges(spark):
    rng = random.Random(3)
    anchors = {("c", b): float(b * 3 + rng.random()) for b in rng.sample(range(1000, 4000), 40)} | {("d", 7): 70.0}
    rows = [("c", rng.randrange(0, 5000), i) for i in range(500)] + [("c", 2000, 1000 + i) for i in range(200)] + [("d", 3, 2000), ("e", 3, 2001)]
    got = flow.block_time_interp(spark.createDataFrame(rows, "chain string, block long, row_id long"), spark.createDataFrame([(c, b, s) for (c, b), s in anchors.items()] + [("d", 7, 99.0)], "chain string, block long, sec double"), keys=["chain"], span=64)
    want = {}
    for c, b, i in rows:
        own = sorted((x, s) for (d, x), s in anchors.items() if d == c)
        want[i] = float(np.interp(b, *zip(*own, strict=True))) if own else None
    got = {r["row_id"]: r["sec"] for r in got.collect()}
    assert got.keys() == want.keys() and all((got[i] is None) == (want[i] is None) and (want[i] is None or abs(got[i] - want[i]) < 1e-6) for i in want)


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(4)
    groups = {"few": rng.normal(size=7), "one": np.array([3.0]), "many": rng.lognormal(size=60_000), "ties": rng.integers(0, 3, 30_000).astype(float), None: rng.normal(size=5000)}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("few", None), ("empty", None)], "g string, v double")
    shares = [0.0, 0.001, 0.1, 0.5, 0.9, 0.9995, 1.0]
    for found in (quantiles.exact_percentiles(df, ["g"], "v", shares), quantiles.weighted_percentiles(df, ["g"], "v", shares)):
        got = {r["g"]: (r["n"], r["percentiles"]) for r in found.collect()}
        assert got.keys() == groups.keys()
        assert all(got[g][0] == len(x) and np.allclose(got[g][1], np.quantile(x, shares), rtol=1e-12) for g, x in groups.items())
    whole = quantiles.exact_percentiles(df, [], "v", [0.5]).collect()
    assert whole[0]["percentiles"][0] == pytest.approx(statistics.median(v for x in groups.values() for v in x))


def test_reading_stops_at_a_files_first_bad_line(spark, tmp_path):
    rng = random.Random(5)
    want = []
    for name, bad in (("a", 700), ("b", None), ("c", 0), ("d", 1999)):
        lines, stopped = [], False
        for i in range(2000):
            line = f'{{"event_id": "{name}{i}", "pnl_c": {rng.random()}}}'
            if i == bad:
                line, stopped = rng.choice(["{", "5x", '{"event_id": "x", "pnl_c": "high"}']), True
            elif i % 50 == 3:
                line = "  "
            elif not stopped:
                want.append(f"{name}{i}")
            lines.append(line)
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # a file is read by many tasks
    try:
        got = files.read_until_bad(spark, str(tmp_path), "event_id string, pnl_c double")
        assert got.rdd.getNumPartitions() > 4 and sorted(r["event_id"] for r in got.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ladder_equals_overlapping_levels(spark):
    rng = random.Random(6)
    levels = [(t, side, round(p, 2), float(rng.randrange(0, 4))) for t in range(6) for side, p0, step in (("ask", 0.5, 0.01), ("bid", 0.49, -0.01)) for p in (p0 + step * k for k in range(7))]
    pairs = [(i, "BUY" if i % 2 else "SELL", i, (i + 1) % 6, 0.1) for i in range(6)]
    got = book.combined_ladder(spark.createDataFrame(pairs, "id int, direction string, long_token int, short_token int, mu double"), spark.createDataFrame(levels, "token int, side string, price double, size double")).collect()
    want = []
    for i, direction, long, short, _ in pairs:
        legs = []
        for token, side in ((long, "ask" if direction == "BUY" else "bid"), (short, "bid" if direction == "BUY" else "ask")):
            at, out = 0.0, []
            for _, _, p, size in sorted((x for x in levels if x[0] == token and x[1] == side), key=lambda x: x[2] if side == "ask" else -x[2]):
                out.append((p, at, at + size))
                at += size
            legs.append(out)
        want += [(i, p, q, max(a, c), min(b, d) - max(a, c)) for p, a, b in legs[0] for q, c, d in legs[1] if min(b, d) > max(a, c)]
    assert sorted((r["id"], r["p_long"], r["p_short"], r["at"], r["depth"]) for r in got) == sorted(want)


def test_cooldown_spans_and_fees(spark):
    plans = spark.createDataFrame([("e", "a", "b", bar, "x") for bar in (5, 10, 17, 22, 23)] + [("f", "a", "b", 1, "x")], "event_id string, short_dd string, long_dd string, bar long, plan string")
    recent = spark.createDataFrame([("e", "a", "b", 10), ("e", "a", "b", 11)], "event_id string, short_dd string, long_dd string, bar long")
    assert sorted((r["event_id"], r["bar"]) for r in signals.cooldown_filter(plans, recent, span=12).collect()) == [("e", 5), ("e", 23), ("f", 1)]
    legs = spark.createDataFrame([("e", "t1", 9.0), ("e", "t2", 9.0), ("e", None, 9.0)], "event_id string, yes_token string, fee_rate double")
    fees = spark.createDataFrame([("t1", 0.1, 2.0), ("t2", 0.2, None)], "token string, fee_rate double, fee_exp double")
    assert sorted((str(r["yes_token"]), r["fee_rate"], r["fee_exp"]) for r in signals.fees_attach(legs, fees).collect()) == [("None", 0.0, 0.0), ("t1", 0.1, 2.0), ("t2", 0.2, 0.0)]

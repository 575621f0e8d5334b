"""Queries over differenced spreads, fills, positions and books, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import book as B
from ..operators import flow as W
from ..operators import positions as O
from ..operators import research as R
from ..operators import spread as S
from ..operators.signals import leg_cost_default, legs_with_tokens, signal_pairs, signals_latest, triggered
from ..operators.trades import greedy, tstat
from ..sources import fixtures as X
from ..sources.shared import written
from . import ladder as L
from .ladder import PAIR, rounded

HS, WS, FLOOR = [3, 6], [24, 48], 1.5
ZS, CAPS, SIGMA = [2.0, 2.5, 3.0], [0.004, 0.006, 0.008], 0.15


def cands(spark: SparkSession, d: str) -> DataFrame:
    return R.diffz_signals(L.spreads(spark, d), hs=HS, windows=WS, z_floor=FLOOR)


def _grid_sql() -> str:
    over = "OVER (PARTITION BY event_id, short_dd, long_dd ORDER BY bar"
    parts = []
    ds = ", ".join(f"spread - lag(spread, {h}) {over}) AS ds{h}, lead(spread, {h + 1}) {over}) - lead(spread, 1) {over}) AS fw{h}" for h in HS) + f", lead(spread, 1) {over}) AS s_in"
    for h in HS:
        for w in WS:
            frame = f"{over} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
            parts.append(f"SELECT event_id, short_dd, long_dd, bar, spread AS S, s_in, {h} AS h, {w} AS w, stddev_samp(ds{h}) {frame} AS sd, CASE WHEN count(ds{h}) {frame} >= {max(10, w // 3)} AND stddev_samp(ds{h}) {frame} > 1e-9 THEN (ds{h} - avg(ds{h}) {frame}) / stddev_samp(ds{h}) {frame} END AS z, ds{h} AS dS, fw{h} AS fwd FROM dd")
    return L.SPREADS + f", dd AS (SELECT *, {ds} FROM sp), ca AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE z IS NOT NULL AND fwd IS NOT NULL AND abs(z) >= {FLOOR})"


CA = _grid_sql()


def _fold(name: str, source: str, keys: str, order: str, free: str) -> str:
    cols = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"t.{k} = f.{k}" for k in cols)
    return f""", {name}0 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS k FROM {source}),
{name}f AS (SELECT {keys}, k, true AS kept, {free} AS free FROM {name}0 WHERE k = 1 UNION ALL SELECT {', '.join('t.' + k for k in cols)}, t.k, t.bar >= f.free, CASE WHEN t.bar >= f.free THEN {free.replace('bar', 't.bar').replace('+ h', '+ t.h')} ELSE f.free END FROM {name}f f JOIN {name}0 t ON {on} AND t.k = f.k + 1),
{name} AS (SELECT t.* FROM {name}0 t JOIN {name}f USING ({keys}, k) WHERE kept)"""


NONOVER = CA + ", c2 AS (SELECT * FROM ca WHERE abs(z) >= 2)" + _fold("no", "c2", "event_id, short_dd, long_dd, h, w", "bar", "bar + h + 1")
NOEVENT = CA + ", c2 AS (SELECT * FROM ca WHERE abs(z) >= 2)" + _fold("ne", "c2", "event_id, h, w", "bar, round(abs(z), 9) DESC, short_dd, long_dd", "bar + h + 1")
FILLS = """fl AS (SELECT event_id AS fill_id, event_type AS event_id, 'L' || (user_id % 4) AS ladder_label, user_id AS wallet, CASE WHEN event_id % 2 = 0 THEN 'YES' ELSE 'NO' END AS outcome, CASE WHEN (event_id // 2) % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
  value AS size, round(least(greatest(value / 500, 0.0), 1.0), 4) AS price, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS sec FROM events),
fs AS (SELECT *, CASE WHEN outcome = 'YES' THEN price ELSE 1 - price END AS p_yes, CASE WHEN (side = 'BUY') = (outcome = 'YES') THEN size ELSE -size END AS flow FROM fl)"""
CLIPS = "cl AS (SELECT l_suppkey AS event_id, CASE WHEN l_returnflag = 'A' THEN 'BUY' ELSE 'SELL' END AS direction, l_quantity::DOUBLE AS shares, l_discount::DOUBLE AS spread, CAST(l_shipdate::DATE - DATE '1970-01-01' AS INTEGER) AS day FROM lineitem)"
POS = CLIPS + ", po AS (SELECT event_id, direction, sum(shares) AS shares, sum(shares * spread) / nullif(sum(shares), 0) AS entry_spread, min(day) AS first_day, count(*) AS n_adds FROM cl GROUP BY ALL)"
WCL = "CASE WHEN direction = 'BUY' THEN least(greatest(entry_spread, 0), 1) ELSE 1 - least(greatest(entry_spread, 0), 1) END"
BOOK = "bk AS (SELECT l_suppkey AS token, CASE WHEN l_returnflag = 'A' THEN 'ask' ELSE 'bid' END AS side, round(CASE WHEN l_returnflag = 'A' THEN 0.41 + 0.01 * l_linenumber ELSE 0.40 - 0.01 * l_linenumber END, 4)::DOUBLE AS price, sum(l_quantity::DOUBLE) AS size FROM lineitem GROUP BY ALL)"
RANKED = BOOK + ", rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY token, side ORDER BY CASE WHEN side = 'ask' THEN price ELSE -price END) AS INTEGER) AS rank FROM bk)"
PAIRS = "pr AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS direction, s_suppkey AS long_token, s_suppkey % (SELECT count(*) FROM supplier) + 1 AS short_token, 0.05::DOUBLE AS mu FROM supplier)"
LADDER = (
    RANKED
    + ", "
    + PAIRS
    + """, lv AS (SELECT token, side, price, sum(size) OVER (PARTITION BY token, side ORDER BY rank) - size AS lo, sum(size) OVER (PARTITION BY token, side ORDER BY rank) AS hi FROM rk),
lg AS (SELECT id, direction, price AS p, lo, hi FROM pr JOIN lv ON token = long_token AND side = CASE WHEN direction = 'BUY' THEN 'ask' ELSE 'bid' END),
st AS (SELECT id, price AS p, lo, hi FROM pr JOIN lv ON token = short_token AND side = CASE WHEN direction = 'BUY' THEN 'bid' ELSE 'ask' END),
ru0 AS (SELECT lg.id, direction, lg.p AS p_long, st.p AS p_short, round(CASE WHEN direction = 'BUY' THEN lg.p + 1 - st.p ELSE 1 - lg.p + st.p END, 4) AS cost, least(lg.hi, st.hi) - greatest(lg.lo, st.lo) AS depth, greatest(lg.lo, st.lo) AS place FROM lg JOIN st ON lg.id = st.id AND lg.lo < st.hi AND st.lo < lg.hi),
ru AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY place) AS INTEGER) AS rung, round(cost * depth, 2) AS notional FROM ru0)"""
)


def book_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = X.table(spark, d, "supplier")
    n = s.agg(F.count("*")).scalar()
    return s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "BUY").otherwise("SELL").alias("direction"), F.col("s_suppkey").alias("long_token"), (F.col("s_suppkey") % n + 1).alias("short_token"), F.lit(0.05).alias("mu"))


def positions(spark: SparkSession, d: str) -> DataFrame:
    return O.accumulate_positions(X.clips(spark, d))


def concentrated(spark: SparkSession, d: str) -> DataFrame:
    g = L.signals(spark, d).select(F.concat_ws("|", *PAIR, F.col("bar").cast("string")).alias("id"), *PAIR, ((F.col("bar") + 1) * 3600).alias("sec"))
    return W.flow_concentration(g, X.fills(spark, d), seconds=6 * 3600)


GRID = (*PAIR, "h", "w", "bar", "z", "S", "dS", "fwd")


def raw_logs(spark: SparkSession, d: str) -> DataFrame:
    """Raw logs with words of 64 hex digits made of events."""
    word = lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 64, "0")
    e = X.table(spark, d, "events")
    topics = F.array(F.lit("0x01"), F.lit("0x02"), F.concat(F.lit("0x"), word(F.col("user_id"))), F.concat(F.lit("0x"), word(F.col("event_id") % 3)))
    data = F.concat(F.lit("0x"), word(F.col("event_id") % 2), word(F.col("user_id")), word(F.round(F.col("value") * 1e6)), word(F.round(F.col("value") * 2e6) + 1), word(F.lit(1000)))
    return e.select(F.concat(F.lit("0x"), F.lower(F.hex("event_id"))).alias("block"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("tx"), topics.alias("topics"), data.alias("data"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "events").select("event_id", F.floor(X.epoch_us(F.col("ts")) / 1_000_000).cast("long").alias("sec"))
    return W.block_time_interp(e.select(F.col("event_id").alias("block"), F.col("event_id").alias("row_id")), e.where(F.col("event_id") % 500 == 0).select(F.col("event_id").alias("block"), "sec"))


def union_of_fills(spark: SparkSession, d: str) -> DataFrame:
    """Fills of two sources, of which one doesn't know wallets, tagged by their tokens."""
    name = lambda last: F.concat_ws("/", "event_id", "ladder_label", last)
    all_ = X.fills(spark, d).withColumn("asset", name(F.left("outcome", F.lit(1)))).drop("event_id", "ladder_label", "outcome")
    legs = X.universe(spark, d).withColumns({"yes_token": name(F.lit("Y")), "no_token": name(F.lit("N"))})
    return W.fills_build([all_.where("fill_id % 3 > 0"), all_.where("fill_id % 3 = 0").drop("wallet")], legs).select("fill_id", "event_id", "ladder_label", "asset", "outcome", "side", "size", "price", "sec", "wallet")


def ledger(spark: SparkSession, d: str) -> DataFrame:
    return O.ledger_replay(L.signals(spark, d), L.spreads(spark, d), keys=PAIR)


def detected(spark: SparkSession, d: str) -> DataFrame:
    return O.reconcile_detect(X.event_legs(spark, d), X.holdings(spark, d))


def planned(spark: SparkSession, d: str) -> DataFrame:
    held = written(detected(spark, d), "detected")
    tracked = held.where("short_leg % 2 = 0").unionByName(held.where("short_leg % 3 = 0").withColumn("direction", F.lit("NONE")))
    return O.reconcile_plan(held, tracked, ["event_id", "short_leg", "long_leg", "direction"])


def closed(spark: SparkSession, d: str) -> DataFrame:
    rows = X.table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "A", "BUY").otherwise("SELL").alias("direction"), F.col("l_extendedprice").cast("double").alias("cost"), (F.col("l_extendedprice") * (1 + F.col("l_tax") - F.col("l_discount"))).cast("double").alias("proceeds"))
    return O.realized_pnl(rows)


def costed(spark: SparkSession, d: str) -> DataFrame:
    return R.level_cost(cands(spark, d), X.universe(spark, d))


def clean(spark: SparkSession, d: str) -> DataFrame:
    return R.clean_signals(cands(spark, d), z=2.0, sigma_floor=SIGMA)


def deep(spark: SparkSession, d: str) -> DataFrame:
    return R.deep_grid(costed(spark, d), thresholds=ZS, caps=CAPS)


def diffz_grid(spark: SparkSession, d: str) -> DataFrame:
    return R.diffz_grid(costed(spark, d), [1.5, 2.0, 2.5, 3.0])


def on_time(spark: SparkSession, d: str) -> DataFrame:
    """Signals of the sparse panel on its time-true grid, where a missing bar is missing and not skipped."""
    sparse = S.spread_panel(L.P.bars_last(X.price_points(spark, d), minutes=240))
    return R.diffz_signals(R.time_grid(sparse), hs=[3], windows=[24], z_floor=1.0)


def distribution(spark: SparkSession, d: str) -> DataFrame:
    """Trades by event, and the share of all profit that the events down to each one make."""
    t = L.trades(spark, d)
    each = t.groupBy("event_id").agg(F.count("*").alias("n"), F.sum("pnl").alias("total"), F.avg("pnl").alias("mean"), F.avg((F.col("pnl") > 0).cast("double")).alias("hit"), F.min("entry_bar").alias("first"), F.max("entry_bar").alias("last"), F.count_distinct(F.floor(F.col("entry_bar") / 24)).alias("days"))
    best = Window.orderBy(F.desc(F.round("total", 9)), "event_id")  # over one row an event
    share = F.sum("total").over(best.rowsBetween(Window.unboundedPreceding, 0)) / F.nullif(F.sum("total").over(Window.partitionBy()), F.lit(0.0))
    return rounded(each.withColumns({"rank": F.row_number().over(best), "top_share": share}), 6)


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """Trades and profit a month, empty months included."""
    month = lambda bar: F.trunc(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(bar / 24).cast("int")), "month")
    t = L.trades(spark, d).groupBy(month(F.col("entry_bar")).alias("month")).agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"))
    months = t.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return rounded(months.join(t, "month", "left").select(F.date_format("month", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pnl", F.lit(0.0)).alias("pnl")))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Trades and profit a day, empty days included."""
    t = L.trades(spark, d).groupBy(F.floor(F.col("entry_bar") / 24).alias("day")).agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"))
    days = t.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return rounded(days.join(t, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pnl", F.lit(0.0)).alias("pnl")))


def tightness(spark: SparkSession, d: str) -> DataFrame:
    each = R.reversion(costed(spark, d)).withColumn("cap", F.explode(F.array(*[F.lit(c) for c in CAPS]))).where(F.col("max_leg") <= F.col("cap"))
    net = F.col("gross") - F.col("cost")
    return rounded(each.groupBy("h", "w", "cap").agg(F.count("*").alias("n"), F.avg("gross").alias("gross"), F.avg(net).alias("net"), F.avg((net > 0).cast("double")).alias("hit")).where("n >= 30"))


def conditioned(spark: SparkSession, d: str) -> DataFrame:
    """Trades whose flow before the signal comes from one wallet or several, and from above or below the median share."""
    t = L.trades(spark, d).withColumn("id", F.concat_ws("|", *PAIR, F.col("signal_bar").cast("string")))
    held = t.join(concentrated(spark, d), "id").where("top_share is not null").select("pnl", "top_share")
    median = held.agg(F.percentile("top_share", F.lit(0.5)).alias("median"), F.count("*").alias("m")).where("m >= 24")
    lone = held.select("pnl", F.when(F.col("top_share") >= 0.999, "lone").otherwise("multi").alias("part"))
    half = held.join(F.broadcast(median)).select("pnl", F.when(F.col("top_share") >= F.col("median"), "high").otherwise("low").alias("part"))  # one row
    return rounded(lone.unionByName(half).groupBy("part").agg(F.count("*").alias("n"), F.avg("pnl").alias("mean"), F.avg((F.col("pnl") > 0).cast("double")).alias("hit"), tstat(F.col("pnl")).alias("t")))


def flow_reversion(spark: SparkSession, d: str) -> DataFrame:
    """Reversion trades on forward-filled legs with the concentration of the flow before each one that is kept."""
    kept = R.flow_reversion_trades(L.spreads(spark, d), h=6, window=48, least=20, z=2.0).withColumn("id", F.concat_ws("|", *PAIR, F.col("bar").cast("string")))
    kept = leg_cost_default(kept, X.universe(spark, d).where("ladder_order < 3"))
    flow = W.flow_concentration(kept.select("id", *PAIR, ((F.col("bar") + 1) * 3600).alias("sec")), X.fills(spark, d), seconds=6 * 3600)
    return kept.join(flow, "id", "left").select(*PAIR, "bar", "z", ((F.col("gross") - F.col("cost")) * 100).alias("rev_c"), "top_share", F.coalesce("wallets", F.lit(0)).alias("wallets"))


def budgeted(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot's plans are the lines of sixteen orders."""
    plans = X.clips(spark, d).select(F.floor(F.col("order_key") / 16).alias("snapshot"), F.struct("order_key", "line").alias("seq"), "event_id", "shares", O.wcl_per_share(F.col("direction"), F.col("spread")).alias("loss"))
    return rounded(B.loss_budget(plans, total=400.0, per_event=20.0).select("snapshot", "event_id", "seq.order_key", "seq.line", "shares", "wcl"), 6)


def walked(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with fees on the long leg, a budget for the worst loss and a gate at twice the round trip's cost."""
    p = book_pairs(spark, d).withColumns({"mu": F.when(F.col("direction") == "BUY", 0.3).otherwise(-0.3), "fee_rate_long": F.lit(0.1), "fee_exp_long": F.lit(1.0), "spread": F.lit(0.2), "wcl_budget": F.lit(60.0)})
    return rounded(B.book_walk(p, X.book(spark, d), ratio=2.0), 6)


QUERIES = {
    "diffz_signals_grid": lambda s, d: rounded(cands(s, d).select(*GRID)),
    "diffz_signals_time_grid": lambda s, d: rounded(on_time(s, d).select(*GRID)),
    "deep_candidates": lambda s, d: rounded(R.diffz_signals(L.spreads(s, d), hs=[6], windows=[48], z_floor=2.0, least=20).select(*GRID)),
    "nonoverlap_pair": lambda s, d: rounded(R.nonoverlap_pair(cands(s, d), z=2.0).select(*PAIR, "h", "w", "bar", "z", "fwd")),
    "nonoverlap_event": lambda s, d: rounded(R.nonoverlap_event(cands(s, d), z=2.0).select(*PAIR, "h", "w", "bar", "z", "fwd")),
    "clean_signals": lambda s, d: rounded(clean(s, d).select(*PAIR, "h", "w", "bar", "z")),
    "diffz_grid": lambda s, d: rounded(diffz_grid(s, d)),
    "top_configs": lambda s, d: rounded(R.top_configs(diffz_grid(s, d), by="rev_net", least=50, n=8)),
    "top_configs_deep": lambda s, d: rounded(R.top_configs(deep(s, d), by="t", least=20)),
    "diffz_confirm": lambda s, d: rounded(R.diffz_confirm(cands(s, d), z=2.0)),
    "tightness_sweep": tightness,
    "signal_legs_tokens": lambda s, d: legs_with_tokens(triggered(costed(s, d), hs=[6], z=2.5, cap=0.006), L.tokened(s, d)),
    "signal_pairs": lambda s, d: signal_pairs(triggered(costed(s, d), hs=[6], z=2.5, cap=0.006)),
    "event_study": lambda s, d: rounded(R.event_study(cands(s, d)), 6),
    "grid_pivot": lambda s, d: rounded(R.diffz_grid(cands(s, d), [1.5, 2.0, 2.5]).groupBy("h", "w").pivot("z_enter", [1.5, 2.0, 2.5]).agg(F.first("gross")).toDF("h", "w", "z_15", "z_20", "z_25")),
    "deep_grid": lambda s, d: rounded(deep(s, d), 7),
    "signed_symmetry": lambda s, d: rounded(R.signed_symmetry(cands(s, d), z=2.0)),
    "event_bootstrap": lambda s, d: rounded(R.event_bootstrap(L.trades(s, d))),
    "signal_funnel": lambda s, d: R.signal_funnel(cands(s, d), z=2.0, sigma_floor=SIGMA),
    "event_distribution": distribution,
    "monthly_activity": monthly,
    "daily_activity": daily,
    "flow_reversion_trades": lambda s, d: rounded(flow_reversion(s, d), 7),
    "horizon_autocorr": lambda s, d: rounded(R.horizon_autocorr(L.spreads(s, d))),
    "variance_ratio": lambda s, d: rounded(R.variance_ratio(L.spreads(s, d))),
    "variance_ratio_summary": lambda s, d: rounded(R.variance_ratio_summary(L.spreads(s, d)), 7),
    "half_life": lambda s, d: rounded(R.half_life(L.spreads(s, d)), 7),
    "half_life_summary": lambda s, d: rounded(R.half_life_summary(L.spreads(s, d)), 6),
    "tail_reversion": lambda s, d: rounded(R.tail_reversion(cands(s, d), z=2.5)),
    "stale_fraction": lambda s, d: rounded(R.stale_fraction(L.spreads(s, d))),
    "median_bar": lambda s, d: R.median_bar(L.P.bars_last(X.price_points(s, d))),
    "flow_sign": lambda s, d: rounded(W.flow_sign(X.fills(s, d)).select("fill_id", "p_yes", "flow")),
    "flow_concentration": lambda s, d: rounded(concentrated(s, d)),
    "flow_conditioned": conditioned,
    "flow_depth": lambda s, d: rounded(W.flow_depth(X.fills(s, d))),
    "flow_depth_by_leg": lambda s, d: rounded(W.leg_depth(X.fills(s, d))),
    "fills_build": union_of_fills,
    "universe_fills": lambda s, d: W.universe_fills(X.fills(s, d), X.universe(s, d).where("ladder_order < 2")).select("fill_id"),
    "chainlog_decode": lambda s, d: W.chainlog_decode(raw_logs(s, d), "0x" + "1".rjust(64, "0")),
    "block_time_interp": lambda s, d: rounded(blocks(s, d), 3),
    "wcl_per_share": lambda s, d: rounded(positions(s, d).select(*O.KEY, O.wcl_per_share(F.col("direction"), F.col("entry_spread")).alias("wcl"))),
    "accumulate_positions": lambda s, d: rounded(positions(s, d)),
    "open_wcl": lambda s, d: rounded(O.open_wcl(positions(s, d)), 5),
    "open_wcl_by_event": lambda s, d: rounded(O.open_wcl(positions(s, d), "event_id"), 6),
    "payoff_risk": lambda s, d: rounded(O.payoff_risk(positions(s, d)).select(*O.KEY, "max_loss", "max_gain", "reward_risk"), 7),
    "recommended_size": lambda s, d: O.recommended_size(L.signals(s, d).withColumn("unit_cost", F.col("p_long") + 1 - F.col("p_short"))).select(*PAIR, "bar", "shares"),
    "held_filter": lambda s, d: O.held_filter(L.signals(s, d), ledger(s, d).where("status = 'open'"), PAIR).select(*PAIR, "bar"),
    "exits_due": lambda s, d: O.exits_due(positions(s, d), day=9240, hold=100).select(*O.KEY, "first_day"),
    "realized_pnl": lambda s, d: rounded(closed(s, d), 3),
    "ledger_replay": lambda s, d: rounded(ledger(s, d)),
    "ledger_summary": lambda s, d: rounded(O.ledger_summary(ledger(s, d))),
    "reconcile_detect": detected,
    "reconcile_plan": planned,
    "open_mtm": lambda s, d: rounded(O.open_mtm(book_pairs(s, d).select("id", F.col("long_token").alias("token_a"), F.col("short_token").alias("token_b"), F.lit(100.0).alias("shares"), F.lit(60.0).alias("cost")), B.best_quotes(X.book(s, d)).select("token", "bid")).select("id", "mtm")),
    "best_quotes": lambda s, d: rounded(B.best_quotes(X.book(s, d))),
    "book_top_n": lambda s, d: B.book_top_n(X.book(s, d), 5),
    "combined_ladder": lambda s, d: rounded(B.combined_ladder(book_pairs(s, d), X.book(s, d)).drop("at")),
    "book_walk": walked,
    "book_walk_plain": lambda s, d: rounded(B.book_walk(book_pairs(s, d), X.book(s, d)), 6),
    "exit_quotes": lambda s, d: B.exit_quotes(book_pairs(s, d).select("id", F.col("long_token").alias("token_a"), F.col("short_token").alias("token_b"), F.lit(100.0).alias("shares")), X.book(s, d)).select("id", "bid_a", "bid_b", "size_a", "size_b", "depth_ok"),
    "loss_budget": budgeted,
}

ZC = "event_id, short_dd, long_dd, h, w, bar, round(z, 6) AS z"
DETECT = """lgs AS (SELECT s_nationkey AS event_id, s_suppkey AS leg, 'Y' || s_suppkey AS yes, 'N' || s_suppkey AS no FROM supplier), hd AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'Y' ELSE 'N' END || l_suppkey AS token, sum(l_quantity::DOUBLE) AS size FROM lineitem GROUP BY ALL),
ow AS (SELECT event_id, leg, 'yes' AS o, yes AS token, size FROM lgs JOIN hd ON token = yes UNION ALL SELECT event_id, leg, 'no', no, size FROM lgs JOIN hd ON token = no),
pp AS (SELECT a.event_id, a.leg AS short_leg, b.leg AS long_leg, CASE WHEN b.o = 'yes' THEN 'BUY' ELSE 'SELL' END AS direction, b.token AS token_a, a.token AS token_b, CAST(floor(least(a.size, b.size)) AS BIGINT) AS shares FROM ow a JOIN ow b ON a.event_id = b.event_id AND a.leg < b.leg AND a.o <> b.o AND a.size >= 1 AND b.size >= 1 AND least(a.size, b.size) >= 0.5 * greatest(a.size, b.size)),
pk AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY short_leg, long_leg, direction) AS k FROM pp),
fd AS (SELECT event_id, k, true AS kept, [token_a, token_b] AS used FROM pk WHERE k = 1 UNION ALL SELECT p.event_id, p.k, NOT list_has_any(f.used, [p.token_a, p.token_b]), CASE WHEN list_has_any(f.used, [p.token_a, p.token_b]) THEN f.used ELSE list_concat(f.used, [p.token_a, p.token_b]) END FROM fd f JOIN pk p ON p.event_id = f.event_id AND p.k = f.k + 1),
de AS (SELECT pk.* EXCLUDE (k) FROM pk JOIN fd USING (event_id, k) WHERE kept)"""
LEDGER = (
    L.SIGNALS
    + """, le AS (SELECT event_id, short_dd, long_dd, bar, 1 AS kind, direction, spread FROM sg UNION ALL SELECT event_id, short_dd, long_dd, bar, 0, NULL, spread FROM sp),
lk AS (SELECT *, row_number() OVER (PARTITION BY event_id, short_dd, long_dd ORDER BY bar, kind) AS k FROM le),
lf AS (SELECT event_id, short_dd, long_dd, k, CASE WHEN kind = 1 THEN bar END AS e_bar, CASE WHEN kind = 1 THEN direction END AS e_dir, CASE WHEN kind = 1 THEN spread END AS e_s, NULL::BIGINT AS c_bar, NULL::VARCHAR AS c_dir, NULL::DOUBLE AS c_s, NULL::BIGINT AS x_bar, NULL::DOUBLE AS x_s FROM lk WHERE k = 1
  UNION ALL SELECT t.event_id, t.short_dd, t.long_dd, t.k,
    CASE WHEN f.e_bar IS NULL AND t.kind = 1 THEN t.bar WHEN f.e_bar IS NOT NULL AND t.kind = 0 AND t.bar - f.e_bar >= 24 THEN NULL ELSE f.e_bar END,
    CASE WHEN f.e_bar IS NULL AND t.kind = 1 THEN t.direction WHEN f.e_bar IS NOT NULL AND t.kind = 0 AND t.bar - f.e_bar >= 24 THEN NULL ELSE f.e_dir END,
    CASE WHEN f.e_bar IS NULL AND t.kind = 1 THEN t.spread WHEN f.e_bar IS NOT NULL AND t.kind = 0 AND t.bar - f.e_bar >= 24 THEN NULL ELSE f.e_s END,
    CASE WHEN t.kind = 0 AND t.bar - f.e_bar >= 24 THEN f.e_bar END, CASE WHEN t.kind = 0 AND t.bar - f.e_bar >= 24 THEN f.e_dir END, CASE WHEN t.kind = 0 AND t.bar - f.e_bar >= 24 THEN f.e_s END,
    CASE WHEN t.kind = 0 AND t.bar - f.e_bar >= 24 THEN t.bar END, CASE WHEN t.kind = 0 AND t.bar - f.e_bar >= 24 THEN t.spread END
  FROM lf f JOIN lk t ON t.event_id = f.event_id AND t.short_dd = f.short_dd AND t.long_dd = f.long_dd AND t.k = f.k + 1),
lg AS (SELECT event_id, short_dd, long_dd, c_bar AS entry_bar, c_dir AS direction, c_s AS entry_spread, x_bar AS exit_bar, x_s AS exit_spread, 'closed' AS status, round((CASE WHEN c_dir = 'BUY' THEN 1 ELSE -1 END) * (x_s - c_s) * 100 - 1, 4) AS pnl_c FROM lf WHERE c_bar IS NOT NULL
  UNION ALL SELECT event_id, short_dd, long_dd, e_bar, e_dir, e_s, NULL, NULL, 'open', NULL FROM (SELECT *, max(k) OVER (PARTITION BY event_id, short_dd, long_dd) AS mk FROM lf) WHERE k = mk AND e_bar IS NOT NULL)"""
)
CONC = L.SIGNALS + ", " + FILLS + """, cw AS (SELECT concat_ws('|', g.event_id, short_dd, long_dd, bar) AS id, wallet, abs(sum(flow)) AS net FROM sg g JOIN fs ON fs.event_id = g.event_id AND (fs.ladder_label = short_dd OR fs.ladder_label = long_dd) AND sec > (bar + 1) * 3600 - 21600 AND sec <= (bar + 1) * 3600 GROUP BY ALL),
cc AS (SELECT id, count(*) AS wallets, max(net) / nullif(sum(net), 0) AS top_share FROM cw GROUP BY id)"""
COSTED = CA + ", " + L.LEGS + """, cc AS (SELECT ca.*, ls.market_spread + ll.market_spread + 2 * (CASE WHEN ll.fee_rate > 0 AND S > 0 AND S < 1 THEN ll.fee_rate * pow(S * (1 - S), ll.fee_exp) ELSE 0 END + CASE WHEN ls.fee_rate > 0 AND S > 0 AND S < 1 THEN ls.fee_rate * pow((1 - S) * S, ls.fee_exp) ELSE 0 END) AS cost,
  greatest(ls.market_spread, ll.market_spread) AS max_leg FROM ca JOIN legs ls ON ls.event_id = ca.event_id AND ls.ladder_label = short_dd JOIN legs ll ON ll.event_id = ca.event_id AND ll.ladder_label = long_dd)"""
_values = lambda xs: ", ".join(f"({x}::DOUBLE)" for x in xs)
ZGRID = COSTED + f", zg AS (SELECT h, w, t AS z_enter, count(*) AS n, avg(-sign(z) * fwd) AS gross, avg((-sign(z) * fwd > 0)::INT) AS hit, avg(-sign(z) * fwd - cost) AS rev_net, avg(sign(z) * fwd - cost) AS mom_net, avg((-sign(z) * fwd < -cost)::INT) AS mom_hit, avg(cost) AS mean_cost FROM cc JOIN (VALUES {_values([1.5, 2.0, 2.5, 3.0])}) v(t) ON abs(z) >= t GROUP BY ALL)"
ZGRID_COLS = "h, w, z_enter, n, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("gross", "hit", "rev_net", "mom_net", "mom_hit", "mean_cost"))
DEEP = COSTED + f", c3 AS (SELECT cc.*, z_enter, cap FROM cc JOIN (VALUES {_values(ZS)}) v(z_enter) ON abs(z) >= z_enter JOIN (VALUES {_values(CAPS)}) c(cap) ON max_leg <= cap)" + _fold("dg", "c3", "event_id, short_dd, long_dd, h, w, z_enter, cap", "bar", "bar + h + 1")
DEEP += ", dn AS (SELECT *, (-sign(z) * fwd - cost) * 100 AS net FROM dg), dd_ AS (SELECT h, w, z_enter, cap, count(*) AS n, CASE WHEN count(*) >= 8 THEN avg(net) END AS net_c, CASE WHEN count(*) >= 8 THEN avg((net > 0)::INT) END AS hit, CASE WHEN count(*) >= 8 THEN avg(net) / nullif(stddev_samp(net), 0) * sqrt(count(*)) END AS t FROM dn GROUP BY ALL)"
TIMED = L.EV.replace("3600000000.0", "14400000000.0") + """, s0 AS (SELECT a.event_id, a.ladder_label AS short_dd, b.ladder_label AS long_dd, a.bar, b.p - a.p AS spread FROM bars a JOIN bars b ON a.event_id = b.event_id AND a.bar = b.bar AND (a.ladder_order, a.ladder_label) < (b.ladder_order, b.ladder_label)),
g1 AS (SELECT event_id, short_dd, long_dd, min(bar) AS lo, max(bar) AS hi FROM s0 GROUP BY ALL HAVING count(*) >= 60), g0 AS (SELECT event_id, short_dd, long_dd, unnest(generate_series(lo, hi)) AS bar FROM g1), sp AS (SELECT * FROM g0 LEFT JOIN s0 USING (event_id, short_dd, long_dd, bar))"""
_w = "OVER (PARTITION BY event_id, short_dd, long_dd ORDER BY bar"
TIMED += f", dd AS (SELECT *, spread - lag(spread, 3) {_w}) AS ds, lead(spread, 4) {_w}) - lead(spread, 1) {_w}) AS fwd FROM sp), tg AS (SELECT event_id, short_dd, long_dd, bar, spread AS S, 3 AS h, 24 AS w, fwd, ds AS dS, CASE WHEN count(ds) {_w} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) >= 10 AND stddev_samp(ds) {_w} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) > 1e-9 THEN (ds - avg(ds) {_w} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)) / stddev_samp(ds) {_w} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) END AS z FROM dd)"
FLOWREV = CA.replace(">= 16 AND", ">= 20 AND") + ", c2 AS (SELECT * FROM ca WHERE abs(z) >= 2 AND h = 6 AND w = 48)" + _fold("no", "c2", "event_id, short_dd, long_dd, h, w", "bar", "bar + h + 1") + ", " + L.LEGS + ", l3 AS (SELECT * FROM legs WHERE ladder_order < 3), " + FILLS
FLOWREV += """, fw AS (SELECT n.event_id, short_dd, long_dd, bar, wallet, abs(sum(flow)) AS net FROM no n JOIN fs ON fs.event_id = n.event_id AND (fs.ladder_label = short_dd OR fs.ladder_label = long_dd) AND sec > (bar + 1) * 3600 - 21600 AND sec <= (bar + 1) * 3600 GROUP BY ALL),
fc AS (SELECT event_id, short_dd, long_dd, bar, count(*) AS wallets, max(net) / nullif(sum(net), 0) AS top_share FROM fw GROUP BY ALL)"""
R_ = "WITH RECURSIVE "
TRIGGERED = f"{CA}, {L.LEGS}, tg AS (SELECT ca.* FROM ca JOIN legs a ON a.event_id = ca.event_id AND a.ladder_label = short_dd JOIN legs b ON b.event_id = ca.event_id AND b.ladder_label = long_dd WHERE h = 6 AND abs(z) >= 2.5 AND greatest(a.market_spread, b.market_spread) <= 0.006)"
SQL = {
    "diffz_signals_grid": f"WITH {CA} SELECT {ZC}, round(S, 9) AS S, round(dS, 9) AS dS, round(fwd, 9) AS fwd FROM ca",
    "diffz_signals_time_grid": f"WITH {TIMED} SELECT {ZC}, round(S, 9) AS S, round(dS, 9) AS dS, round(fwd, 9) AS fwd FROM tg WHERE abs(z) >= 1 AND fwd IS NOT NULL",
    "deep_candidates": f"WITH {CA.replace('>= 16 AND', '>= 20 AND')} SELECT {ZC}, round(S, 9) AS S, round(dS, 9) AS dS, round(fwd, 9) AS fwd FROM ca WHERE h = 6 AND w = 48 AND abs(z) >= 2",
    "nonoverlap_pair": f"{R_}{NONOVER} SELECT {ZC}, round(fwd, 9) AS fwd FROM no",
    "nonoverlap_event": f"{R_}{NOEVENT} SELECT {ZC}, round(fwd, 9) AS fwd FROM ne",
    "clean_signals": f"{R_}{NOEVENT.replace('WHERE abs(z) >= 2)', f'WHERE abs(z) >= 2 AND sd >= {SIGMA} AND s_in >= 0)')} SELECT {ZC} FROM ne",
    "diffz_grid": f"WITH {ZGRID} SELECT {ZGRID_COLS} FROM zg",
    "top_configs": f"WITH {ZGRID} SELECT {ZGRID_COLS} FROM zg WHERE n >= 50 ORDER BY round(zg.rev_net, 9) DESC, h, w, z_enter LIMIT 8",
    "top_configs_deep": f"{R_}{DEEP} SELECT h, w, z_enter, cap, n, round(net_c, 9) AS net_c, round(hit, 9) AS hit, round(t, 9) AS t FROM dd_ WHERE n >= 20 AND t IS NOT NULL ORDER BY round(dd_.t, 9) DESC, h, w, z_enter, cap LIMIT 12",
    "diffz_confirm": f"WITH {CA} SELECT h, w, round(avg(fwd) FILTER (z > 0 AND S >= 0), 9) AS up_pos, round(avg(fwd) FILTER (z > 0 AND S < 0), 9) AS up_neg, round(avg(fwd) FILTER (z < 0 AND S >= 0), 9) AS down_pos, round(avg(fwd) FILTER (z < 0 AND S < 0), 9) AS down_neg FROM ca WHERE abs(z) >= 2 GROUP BY ALL",
    "tightness_sweep": f"WITH {COSTED} SELECT h, w, cap, count(*) AS n, round(avg(-sign(z) * fwd), 9) AS gross, round(avg(-sign(z) * fwd - cost), 9) AS net, round(avg((-sign(z) * fwd - cost > 0)::INT), 9) AS hit FROM cc JOIN (VALUES {_values(CAPS)}) v(cap) ON max_leg <= cap GROUP BY ALL HAVING count(*) >= 30",
    "signal_legs_tokens": f"WITH {TRIGGERED}, lg AS (SELECT event_id, short_dd AS ladder_label FROM tg UNION SELECT event_id, long_dd FROM tg) SELECT event_id, ladder_label, event_id || '/' || ladder_label || '/Y' AS yes_token, event_id || '/' || ladder_label || '/N' AS no_token FROM lg JOIN legs USING (event_id, ladder_label) WHERE resolution IS NULL",
    "signal_pairs": f"WITH {TRIGGERED} SELECT DISTINCT event_id, short_dd, long_dd FROM tg",
    "event_study": f"WITH {CA}, q AS (SELECT h, w, quantile_cont(z, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM ca GROUP BY ALL HAVING count(*) >= 50), b AS (SELECT h, w, z, fwd, CAST(len(list_filter(cuts, lambda c: c + 1e-9 < z)) AS INTEGER) AS bucket FROM ca JOIN q USING (h, w)) SELECT h, w, bucket, count(*) AS n, round(avg(z), 6) AS mean_z, round(avg(fwd), 6) AS mean_fwd FROM b GROUP BY ALL",
    "grid_pivot": f"WITH {CA} SELECT h, w, round(avg(-sign(z) * fwd) FILTER (abs(z) >= 1.5), 9) AS z_15, round(avg(-sign(z) * fwd) FILTER (abs(z) >= 2), 9) AS z_20, round(avg(-sign(z) * fwd) FILTER (abs(z) >= 2.5), 9) AS z_25 FROM ca GROUP BY ALL",
    "deep_grid": f"{R_}{DEEP} SELECT h, w, z_enter, cap, n, round(net_c, 7) AS net_c, round(hit, 7) AS hit, round(t, 7) AS t FROM dd_",
    "signed_symmetry": f"WITH {CA}, g AS (SELECT *, -sign(z) * fwd AS gross FROM ca WHERE abs(z) >= 2) SELECT h, w, count(*) FILTER (z > 0) AS n_up, count(*) FILTER (z <= 0) AS n_down, CASE WHEN count(*) FILTER (z > 0) >= 8 THEN round(avg(gross) FILTER (z > 0) / stddev_samp(gross) FILTER (z > 0) * sqrt(count(*) FILTER (z > 0)), 9) END AS t_up, CASE WHEN count(*) FILTER (z <= 0) >= 8 THEN round(avg(gross) FILTER (z <= 0) / stddev_samp(gross) FILTER (z <= 0) * sqrt(count(*) FILTER (z <= 0)), 9) END AS t_down FROM g GROUP BY ALL",
    "event_bootstrap": f"{L.W}{L.TRADES}, e AS (SELECT event_id, sum(pnl) AS s, count(*) AS n, row_number() OVER (ORDER BY event_id) - 1 AS k FROM tr GROUP BY 1), m AS (SELECT count(*) AS c FROM e), p AS (SELECT d.draw, ('0x' || substr(md5(d.draw || '-' || i.i), 1, 8))::BIGINT % m.c AS k FROM range(5000) d(draw), m, LATERAL (SELECT unnest(generate_series(1, m.c)) AS i) i), b AS (SELECT draw, sum(s) / sum(n) AS mm FROM p JOIN e USING (k) GROUP BY 1) SELECT round(avg(mm), 9) AS mean, round(quantile_cont(mm, 0.025), 9) AS low, round(quantile_cont(mm, 0.975), 9) AS high, round(avg((mm <= 0)::INT), 9) AS p_le_0 FROM b",
    "signal_funnel": f"WITH {CA} SELECT h, w, count(*) AS n, count(*) FILTER (abs(z) >= 2) AS n_z, count(*) FILTER (abs(z) >= 2 AND sd < {SIGMA}) AS dropped_sigma, count(*) FILTER (abs(z) >= 2 AND sd >= {SIGMA} AND s_in < 0) AS dropped_inverted, count(*) FILTER (abs(z) >= 2 AND sd >= {SIGMA} AND s_in >= 0) AS n_clean FROM ca GROUP BY ALL",
    "event_distribution": f"{L.W}{L.TRADES}, e AS (SELECT event_id, count(*) AS n, sum(pnl) AS total, avg(pnl) AS mean, avg((pnl > 0)::INT) AS hit, min(entry_bar) AS first, max(entry_bar) AS last, count(DISTINCT entry_bar // 24) AS days FROM tr GROUP BY 1), r AS (SELECT *, CAST(row_number() OVER (ORDER BY round(total, 9) DESC, event_id) AS INTEGER) AS rank FROM e) SELECT event_id, n, round(total, 6) AS total, round(mean, 6) AS mean, round(hit, 6) AS hit, first, last, days, rank, round(sum(total) OVER (ORDER BY rank) / nullif(sum(total) OVER (), 0), 6) AS top_share FROM r",
    "daily_activity": f"{L.W}{L.TRADES}, t AS (SELECT entry_bar // 24 AS day, count(*) AS n, sum(pnl) AS pnl FROM tr GROUP BY 1), a AS (SELECT unnest(generate_series(min(day), max(day))) AS day FROM t) SELECT day, coalesce(n, 0) AS n, round(coalesce(pnl, 0), 9) AS pnl FROM a LEFT JOIN t USING (day)",
    "monthly_activity": f"{L.W}{L.TRADES}, t AS (SELECT date_trunc('month', DATE '1970-01-01' + CAST(entry_bar // 24 AS INTEGER)) AS m, count(*) AS n, sum(pnl) AS pnl FROM tr GROUP BY 1), a AS (SELECT unnest(generate_series(min(m)::TIMESTAMP, max(m)::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM t) SELECT strftime(a.m, '%Y-%m') AS month, coalesce(n, 0) AS n, round(coalesce(pnl, 0), 9) AS pnl FROM a LEFT JOIN t ON a.m = t.m",
    "flow_reversion_trades": f"{R_}{FLOWREV} SELECT n.event_id, n.short_dd, n.long_dd, n.bar, round(z, 6) AS z, round((-sign(z) * fwd - coalesce(a.market_spread, 0.2) - coalesce(b.market_spread, 0.2)) * 100, 7) AS rev_c, round(top_share, 7) AS top_share, coalesce(wallets, 0) AS wallets FROM no n LEFT JOIN fc ON fc.event_id = n.event_id AND fc.short_dd = n.short_dd AND fc.long_dd = n.long_dd AND fc.bar = n.bar LEFT JOIN l3 a ON a.event_id = n.event_id AND a.ladder_label = n.short_dd LEFT JOIN l3 b ON b.event_id = n.event_id AND b.ladder_label = n.long_dd",
    "horizon_autocorr": f"WITH {L.SPREADS}, a AS (SELECT *, row_number() OVER (PARTITION BY event_id, short_dd, long_dd ORDER BY bar) AS rn FROM sp), b AS (SELECT event_id, short_dd, long_dd, bar, spread - lag(spread) OVER (PARTITION BY event_id, short_dd, long_dd ORDER BY bar) AS d FROM a WHERE rn % 6 = 0), c AS (SELECT *, d / nullif(stddev_pop(d) OVER (PARTITION BY event_id, short_dd, long_dd), 0) AS u FROM b WHERE d IS NOT NULL), e AS (SELECT u, lag(u) OVER (PARTITION BY event_id, short_dd, long_dd ORDER BY bar) AS v FROM c) SELECT count(*) AS n, round(corr(u, v), 9) AS rho FROM e WHERE u IS NOT NULL AND v IS NOT NULL",
    "variance_ratio": f"WITH {L.SPREADS}, a AS (SELECT event_id, short_dd, long_dd, spread - lag(spread) OVER w AS d1, spread - lag(spread, 6) OVER w AS dq FROM sp WINDOW w AS (PARTITION BY event_id, short_dd, long_dd ORDER BY bar)) SELECT event_id, short_dd, long_dd, round(var_pop(dq) / nullif(6 * var_pop(d1), 0), 9) AS vr FROM a GROUP BY ALL",
    "variance_ratio_summary": f"WITH {L.SPREADS}, a AS (SELECT event_id, short_dd, long_dd, spread - lag(spread) OVER w AS d1, spread - lag(spread, 6) OVER w AS dq FROM sp WINDOW w AS (PARTITION BY event_id, short_dd, long_dd ORDER BY bar)), v AS (SELECT event_id, short_dd, long_dd, var_pop(dq) / nullif(6 * var_pop(d1), 0) AS vr FROM a GROUP BY ALL) SELECT count(*) AS n, round(quantile_cont(vr, 0.5), 7) AS median, round(avg((vr < 1)::INT), 7) AS below_1 FROM v WHERE vr IS NOT NULL",
    "half_life": f"WITH {L.SPREADS}, a AS (SELECT event_id, short_dd, long_dd, spread, lag(spread) OVER (PARTITION BY event_id, short_dd, long_dd ORDER BY bar) AS x FROM sp), b AS (SELECT event_id, short_dd, long_dd, covar_samp(x, spread) / nullif(var_pop(x), 0) AS phi FROM a WHERE x IS NOT NULL GROUP BY ALL) SELECT event_id, short_dd, long_dd, round(phi, 7) AS phi, CASE WHEN phi > 0 AND phi < 1 THEN round(-ln(2) / ln(phi), 7) END AS half_life FROM b",
    "half_life_summary": f"WITH {L.SPREADS}, a AS (SELECT event_id, short_dd, long_dd, spread, lag(spread) OVER (PARTITION BY event_id, short_dd, long_dd ORDER BY bar) AS x FROM sp), b AS (SELECT event_id, short_dd, long_dd, covar_samp(x, spread) / nullif(var_pop(x), 0) AS phi FROM a WHERE x IS NOT NULL GROUP BY ALL), v AS (SELECT CASE WHEN phi > 0 AND phi < 1 THEN -ln(2) / ln(phi) END AS hl FROM b) SELECT count(*) AS n, count(hl) AS n_reverting, round(quantile_cont(hl, 0.5), 6) AS median FROM v",
    "tail_reversion": f"WITH {CA} SELECT h, w, count(*) AS n, round(sum(-sign(z) * fwd) / nullif(sum(abs(dS)), 0), 9) AS share FROM ca WHERE abs(z) >= 2.5 GROUP BY ALL",
    "stale_fraction": f"WITH {L.SPREADS}, a AS (SELECT event_id, spread - lag(spread, 6) OVER (PARTITION BY event_id, short_dd, long_dd ORDER BY bar) AS d FROM sp) SELECT event_id, round(avg((d = 0)::INT), 9) AS stale FROM a WHERE d IS NOT NULL GROUP BY 1",
    "median_bar": f"WITH {L.EV}, b AS (SELECT DISTINCT event_id, bar FROM bars), g AS (SELECT event_id, bar - lag(bar) OVER (PARTITION BY event_id ORDER BY bar) AS gap FROM b) SELECT event_id, quantile_cont(gap::DOUBLE, 0.5) AS median_gap FROM g WHERE gap IS NOT NULL GROUP BY 1",
    "flow_sign": f"WITH {FILLS} SELECT fill_id, round(p_yes, 9) AS p_yes, round(flow, 9) AS flow FROM fs",
    "flow_concentration": f"WITH {CONC} SELECT id, wallets, round(top_share, 9) AS top_share FROM cc",
    "flow_conditioned": f"{L.W}{L.TRADES}, {FILLS}, {CONC[CONC.index('cw AS'):]}, x AS (SELECT pnl, top_share, quantile_cont(top_share, 0.5) OVER () AS md, count(*) OVER () AS m FROM tr JOIN cc ON id = concat_ws('|', event_id, short_dd, long_dd, signal_bar) WHERE top_share IS NOT NULL), y AS (SELECT pnl, CASE WHEN top_share >= 0.999 THEN 'lone' ELSE 'multi' END AS part FROM x UNION ALL SELECT pnl, CASE WHEN top_share >= md THEN 'high' ELSE 'low' END FROM x WHERE m >= 24) SELECT part, count(*) AS n, round(avg(pnl), 9) AS mean, round(avg((pnl > 0)::INT), 9) AS hit, CASE WHEN count(*) >= 8 THEN round(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(count(*)), 9) END AS t FROM y GROUP BY 1",
    "flow_depth": f"WITH {FILLS}, m AS (SELECT event_id, ladder_label, (max(sec) - min(sec)) / 86400.0 AS days, count(DISTINCT wallet) AS wallets, count(*) AS fills FROM fl GROUP BY ALL) SELECT event_id, count(*) AS legs, round(quantile_cont(days, 0.5), 9) AS median_days, round(quantile_cont(days, 0.1), 9) AS p10_days, round(max(days), 9) AS max_days, CAST(max(wallets) AS BIGINT) AS most_wallets, CAST(sum(fills) AS BIGINT) AS fills FROM m GROUP BY 1",
    "flow_depth_by_leg": f"WITH {FILLS} SELECT event_id, ladder_label, round((max(sec) - min(sec)) / 86400.0, 9) AS days, count(DISTINCT wallet) AS wallets, count(*) AS fills FROM fl GROUP BY ALL",
    "fills_build": f"WITH {FILLS} SELECT fill_id, event_id, ladder_label, event_id || '/' || ladder_label || '/' || outcome[1] AS asset, outcome, side, size, price, sec, CASE WHEN fill_id % 3 > 0 THEN wallet END AS wallet FROM fl",
    "universe_fills": f"WITH {FILLS} SELECT fill_id FROM fl WHERE ladder_label IN ('L0', 'L1')",
    "chainlog_decode": "WITH a AS (SELECT event_id, user_id, CAST(round(value * 1e6) AS BIGINT) AS w2, CAST(round(value * 2e6) + 1 AS BIGINT) AS w3, event_id % 2 AS w0 FROM events WHERE event_id % 3 = 1), b AS (SELECT *, CASE WHEN w0 = 0 THEN w2 ELSE w3 END / 1e6 AS usdc, CASE WHEN w0 = 0 THEN w3 ELSE w2 END / 1e6 AS tokens FROM a) SELECT event_id AS block, 't' || event_id AS tx, '0x' || lpad(lower(to_hex(user_id)), 40, '0') AS wallet, lpad(lower(to_hex(user_id)), 64, '0') AS token_id, CASE WHEN w0 = 0 THEN 'BUY' ELSE 'SELL' END AS side, round(tokens, 6) AS tokens, round(usdc, 6) AS usdc, round(usdc / tokens, 6) AS price, 0.001::DOUBLE AS fee FROM b WHERE tokens > 0",
    "block_time_interp": "WITH e AS (SELECT event_id, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS sec FROM events), a AS (SELECT event_id AS block, sec, lead(event_id) OVER (ORDER BY event_id) AS nb, lead(sec) OVER (ORDER BY event_id) AS ns FROM e WHERE event_id % 500 = 0) SELECT e.event_id AS row_id, e.event_id AS block, round(coalesce(a.sec + (e.event_id - a.block) / (a.nb - a.block)::DOUBLE * (a.ns - a.sec), a.sec)::DOUBLE, 3) AS sec FROM e ASOF JOIN a ON e.event_id >= a.block",
    "wcl_per_share": f"WITH {POS} SELECT event_id, direction, round({WCL}, 9) AS wcl FROM po",
    "accumulate_positions": f"WITH {POS} SELECT event_id, direction, round(shares, 9) AS shares, round(entry_spread, 9) AS entry_spread, first_day, n_adds FROM po",
    "open_wcl": f"WITH {POS} SELECT round(sum(shares * {WCL}), 5) AS wcl FROM po",
    "open_wcl_by_event": f"WITH {POS} SELECT event_id, round(sum(shares * {WCL}), 6) AS wcl FROM po GROUP BY 1",
    "payoff_risk": f"WITH {POS} SELECT event_id, direction, round({WCL}, 7) AS max_loss, round(1 - {WCL}, 7) AS max_gain, round((1 - {WCL}) / nullif({WCL}, 0), 7) AS reward_risk FROM po",
    "recommended_size": f"WITH {L.SIGNALS} SELECT event_id, short_dd, long_dd, bar, CAST(least(greatest(floor(400 * (0.5 + 0.5 * least(1.0, abs(z) / 3.0)) / nullif(p_long + 1 - p_short, 0)), 10), 500) AS BIGINT) AS shares FROM sg",
    "held_filter": f"{R_}{LEDGER} SELECT event_id, short_dd, long_dd, bar FROM sg ANTI JOIN (SELECT * FROM lg WHERE status = 'open') USING (event_id, short_dd, long_dd)",
    "exits_due": f"WITH {POS} SELECT event_id, direction, first_day FROM po WHERE 9240 - first_day >= 100",
    "realized_pnl": "WITH c AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'BUY' ELSE 'SELL' END AS direction, (l_extendedprice * (1 + l_tax - l_discount))::DOUBLE - l_extendedprice::DOUBLE AS pnl FROM lineitem) SELECT direction, count(*) AS n, round(sum(pnl), 3) AS total, round(avg((pnl > 0)::INT), 3) AS hit FROM c GROUP BY 1",
    "ledger_replay": f"{R_}{LEDGER} SELECT event_id, short_dd, long_dd, entry_bar, direction, round(entry_spread, 9) AS entry_spread, exit_bar, round(exit_spread, 9) AS exit_spread, status, pnl_c FROM lg",
    "ledger_summary": f"{R_}{LEDGER} SELECT count(*) FILTER (status = 'closed') AS n, count(*) FILTER (status = 'open') AS n_open, round(sum(pnl_c), 9) AS total, round(avg(pnl_c), 9) AS mean, round(avg(CASE WHEN pnl_c IS NOT NULL THEN (pnl_c > 0)::INT END), 9) AS hit FROM lg",
    "reconcile_detect": f"{R_}{DETECT} SELECT * FROM de",
    "reconcile_plan": f"{R_}{DETECT} SELECT event_id, short_leg, long_leg, direction, 'adopt' AS action FROM de WHERE short_leg % 2 <> 0 UNION ALL SELECT event_id, short_leg, long_leg, 'NONE', 'drop' FROM de WHERE short_leg % 3 = 0",
    "open_mtm": f"WITH {BOOK}, {PAIRS}, q AS (SELECT token, max(price) FILTER (side = 'bid') AS bid FROM bk GROUP BY 1) SELECT id, round(100 * (a.bid + b.bid) - 60, 9) AS mtm FROM pr LEFT JOIN q a ON a.token = long_token LEFT JOIN q b ON b.token = short_token",
    "best_quotes": f"WITH {BOOK} SELECT token, max(price) FILTER (side = 'bid') AS bid, min(price) FILTER (side = 'ask') AS ask, round(min(price) FILTER (side = 'ask') - max(price) FILTER (side = 'bid'), 9) AS width FROM bk GROUP BY 1",
    "book_top_n": f"WITH {RANKED} SELECT * FROM rk WHERE rank <= 5",
    "combined_ladder": f"WITH {LADDER} SELECT id, direction, rung, p_long, p_short, cost, depth, notional FROM ru",
    "book_walk_plain": f"""WITH {LADDER.replace("sum(l_quantity::DOUBLE) AS size", "sum(l_quantity::DOUBLE) * 0.5 AS size")}, e AS (SELECT *, CASE WHEN direction = 'BUY' THEN 0.05 - (p_long - p_short) ELSE p_long - p_short - 0.05 END AS edge FROM ru), f AS (SELECT *, max((edge < 0)::INT) OVER (PARTITION BY id ORDER BY rung) AS fails FROM e),
g AS (SELECT *, coalesce(sum(cost * depth) OVER w, 0) AS spent, coalesce(sum(depth) OVER w, 0) AS taken FROM f WHERE fails = 0 WINDOW w AS (PARTITION BY id ORDER BY rung ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), t AS (SELECT *, greatest(0, least(depth, (1000 - spent) / cost, 500 - taken)) AS take FROM g)
SELECT id, direction, CAST(floor(sum(take)) AS BIGINT) AS shares, round(sum(take * cost), 6) AS dollars, round(sum(take * edge) / sum(take), 6) AS avg_edge, arg_max(p_long, rung) AS worst_long, arg_max(p_short, rung) AS worst_short FROM t WHERE take > 0 GROUP BY ALL HAVING floor(sum(take)) >= 10""",
    "book_walk": f"""WITH {LADDER.replace("sum(l_quantity::DOUBLE) AS size", "sum(l_quantity::DOUBLE) * 0.5 AS size")}, q AS (SELECT token, min(price) FILTER (side = 'ask') - max(price) FILTER (side = 'bid') AS width FROM bk GROUP BY 1),
e AS (SELECT ru.*, 0.1 * (ru.p_long * (1 - ru.p_long)) AS fee, CASE WHEN ru.direction = 'BUY' THEN 0.3 - (ru.p_long - ru.p_short) ELSE ru.p_long - ru.p_short + 0.3 END AS raw, a.width + b.width AS width, CASE WHEN ru.direction = 'BUY' THEN 60 / 0.2 ELSE 60 / 0.8 END AS most FROM ru JOIN pr ON pr.id = ru.id JOIN q a ON a.token = long_token JOIN q b ON b.token = short_token WHERE a.width IS NOT NULL AND b.width IS NOT NULL),
e2 AS (SELECT *, raw - fee AS edge, width + first_value(fee) OVER (PARTITION BY id ORDER BY rung) AS full_ FROM e), f AS (SELECT *, max((edge < 2 * full_)::INT) OVER (PARTITION BY id ORDER BY rung) AS fails FROM e2 WHERE full_ > 1e-6),
g AS (SELECT *, coalesce(sum(cost * depth) OVER w, 0) AS spent, coalesce(sum(depth) OVER w, 0) AS taken FROM f WHERE fails = 0 WINDOW w AS (PARTITION BY id ORDER BY rung ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, (1000 - spent) / (cost + fee) AS once, fee / (cost + fee) AS again FROM g), t AS (SELECT *, greatest(0, least(depth, CASE WHEN once >= 1 THEN once * (1 - pow(again, floor(ln(CASE WHEN once >= 1 THEN once ELSE 1 END) / -ln(again)) + 1)) / (1 - again) ELSE 0 END, least(500, most) - taken)) AS take FROM h)
SELECT id, direction, CAST(floor(sum(take)) AS BIGINT) AS shares, round(sum(take * cost), 6) AS dollars, round(sum(take * edge) / sum(take), 6) AS avg_edge, arg_max(p_long, rung) AS worst_long, arg_max(p_short, rung) AS worst_short FROM t WHERE take > 0 GROUP BY ALL HAVING floor(sum(take)) >= 10""",
    "exit_quotes": f"WITH {RANKED}, {PAIRS}, tp AS (SELECT * FROM rk WHERE side = 'bid' AND rank = 1) SELECT id, a.price AS bid_a, b.price AS bid_b, a.size AS size_a, b.size AS size_b, a.size >= 100 AND b.size >= 100 AS depth_ok FROM pr JOIN tp a ON a.token = long_token JOIN tp b ON b.token = short_token",
    "loss_budget": """WITH RECURSIVE p AS (SELECT l_orderkey // 16 AS snapshot, l_suppkey AS event_id, l_orderkey AS order_key, l_linenumber AS line, l_quantity::DOUBLE AS shares, CASE WHEN l_returnflag = 'A' THEN l_discount::DOUBLE ELSE 1 - l_discount::DOUBLE END AS loss FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY order_key, line, event_id, shares, loss) AS k FROM p),
f AS (SELECT snapshot, 0::BIGINT AS k, 0::BIGINT AS event_id, 0::BIGINT AS order_key, 0::BIGINT AS line, 0::BIGINT AS taken, 0::DOUBLE AS wcl, 0::DOUBLE AS used, []::STRUCT(e BIGINT, w DOUBLE)[] AS held FROM k WHERE k = 1
  UNION ALL SELECT snapshot, k, event_id, order_key, line, CASE WHEN ok THEN can ELSE 0 END, CASE WHEN ok THEN can * loss ELSE 0 END, used + CASE WHEN ok THEN can * loss ELSE 0 END, CASE WHEN ok THEN list_append(held, {'e': event_id, 'w': can * loss}) ELSE held END
  FROM (SELECT *, remains > 0 AND can >= 10 AS ok FROM (SELECT *, CAST(least(floor(shares), CASE WHEN loss > 1e-9 THEN floor(round(remains / loss, 6)) ELSE floor(shares) END) AS BIGINT) AS can FROM
    (SELECT t.snapshot, t.k, t.event_id, t.order_key, t.line, t.shares, t.loss, f.used, f.held, round(least(20 - coalesce(list_sum(list_transform(list_filter(f.held, lambda u: u.e = t.event_id), lambda u: u.w)), 0), 400 - f.used), 6) AS remains FROM f JOIN k t ON t.snapshot = f.snapshot AND t.k = f.k + 1) a) b) c)
SELECT snapshot, event_id, order_key, line, taken AS shares, round(wcl, 6) AS wcl FROM f WHERE taken > 0""",
}

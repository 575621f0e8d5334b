"""Queries of the ladder pipeline, from price points to trades, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators import signals as G
from ..operators import spread as S
from ..operators import trades as T
from ..sources import fixtures as X

PAIR = S.PAIR
WINDOW, MIN_OBS = 48, 20


def rounded(df: DataFrame, digits: int = 9, z: int = 6) -> DataFrame:
    """Doubles rounded, so that both engines' sums agree."""
    return df.withColumns({c: F.round(c, z if c == "z" else digits) + F.lit(0.0) for c, kind in df.dtypes if kind == "double"})


def filled(spark: SparkSession, d: str) -> DataFrame:
    return P.bars_ffill(P.bars_last(X.price_points(spark, d)))


def spreads(spark: SparkSession, d: str) -> DataFrame:
    return S.spread_panel(filled(spark, d))


def stats(spark: SparkSession, d: str) -> DataFrame:
    return S.rolling_z(spreads(spark, d), window=WINDOW, min_obs=MIN_OBS)


def signals(spark: SparkSession, d: str) -> DataFrame:
    return G.signals_rolling(stats(spark, d))


def led_signals(spark: SparkSession, d: str) -> DataFrame:
    return G.signals_rolling(T.with_exits(stats(spark, d)))


def trades(spark: SparkSession, d: str) -> DataFrame:
    return T.trades_build(led_signals(spark, d), X.universe(spark, d))


EV = """ev AS (SELECT event_id AS seq, event_type AS event_id, CAST(user_id % 4 AS INTEGER) AS ladder_order, 'L' || (user_id % 4) AS ladder_label, ts,
  CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) AS bar, round(least(greatest(value / 500, 0.0), 1.0), 4) AS p FROM events),
bars AS (SELECT event_id, ladder_order, ladder_label, bar, arg_max(p, (ts, seq)) AS p FROM ev GROUP BY ALL)"""
LEGS = """legs AS (SELECT event_type AS event_id, CAST(user_id % 4 AS INTEGER) AS ladder_order, 'L' || (user_id % 4) AS ladder_label, round(0.002 * (user_id % 4 + 1), 4) AS market_spread,
  round(sum(value), 4) AS liquidity, event_type || ',' || CASE WHEN user_id % 4 % 2 = 0 THEN 'even' ELSE 'odd' END AS tags,
  CASE WHEN user_id % 4 = 0 AND event_type = 'purchase' THEN 1.0::DOUBLE END AS resolution, CASE WHEN event_type = 'click' THEN 0.10::DOUBLE ELSE 0.0 END AS fee_rate, 1.0::DOUBLE AS fee_exp,
  DATE '2024-03-01' + CAST(30 * (user_id % 4) AS INTEGER) AS deadline_date FROM events GROUP BY event_type, user_id % 4)"""
FILLED = (
    EV
    + """, span AS (SELECT event_id, ladder_order, ladder_label, min(bar) lo, max(bar) hi FROM bars GROUP BY ALL),
grid AS (SELECT event_id, ladder_order, ladder_label, unnest(generate_series(lo, hi)) AS bar FROM span),
filled AS (SELECT g.event_id, g.ladder_order, g.ladder_label, g.bar, last_value(b.p IGNORE NULLS) OVER (PARTITION BY g.event_id, g.ladder_label ORDER BY g.bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p
  FROM grid g LEFT JOIN bars b USING (event_id, ladder_order, ladder_label, bar))"""
)
SPREADS = (
    FILLED
    + """, sp AS (SELECT a.event_id, a.ladder_label AS short_dd, b.ladder_label AS long_dd, a.bar, a.p AS p_short, b.p AS p_long, b.p - a.p AS spread
  FROM filled a JOIN filled b ON a.event_id = b.event_id AND a.bar = b.bar AND (a.ladder_order, a.ladder_label) < (b.ladder_order, b.ladder_label))"""
)


def _stats(value: str, source: str, window: int, least: int, name: str) -> str:
    over = f"OVER (PARTITION BY event_id, short_dd, long_dd ORDER BY bar ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
    return f""", {name}0 AS (SELECT *, count({value}) {over} AS n_, avg({value}) {over} AS mu_, stddev_samp({value}) {over} AS sd_ FROM {source}),
{name} AS (SELECT * EXCLUDE (n_, mu_, sd_), CASE WHEN n_ >= {least} THEN mu_ END AS mu, CASE WHEN n_ >= {least} THEN sd_ END AS sigma, CASE WHEN n_ >= {least} THEN ({value} - mu_) / nullif(sd_, 0) END AS z FROM {name}0)"""


STATS = SPREADS + _stats("spread", "sp", WINDOW, MIN_OBS, "st")
SIGNALS = (
    STATS
    + """, sg AS (SELECT * FROM (SELECT *, CASE WHEN z <= -1.75 AND mu - spread >= 0.05 THEN 'BUY' WHEN z >= 1.75 AND spread - mu >= 0.05 THEN 'SELL' END AS direction FROM st WHERE sigma > 1e-6) WHERE direction IS NOT NULL)"""
)
DIFF = SPREADS + ", ds AS (SELECT *, spread - lag(spread, 6) OVER (PARTITION BY event_id, short_dd, long_dd ORDER BY bar) AS dS FROM sp)" + _stats("dS", "ds", 48, 16, "dz")
SIGNAL_COLS = "event_id, short_dd, long_dd, bar, direction"
EXITS = (
    SIGNALS
    + """, rw AS (SELECT *, row_number() OVER (PARTITION BY event_id, short_dd, long_dd ORDER BY bar) AS rn, count(*) OVER (PARTITION BY event_id, short_dd, long_dd) AS last_rn FROM st),
en AS (SELECT s.event_id, s.short_dd, s.long_dd, s.bar AS signal_bar, s.direction, r.rn + 1 AS entry_rn, least(r.rn + 25, r.last_rn) AS horizon FROM sg s JOIN rw r USING (event_id, short_dd, long_dd, bar) WHERE r.rn + 1 <= r.last_rn),
ht AS (SELECT e.event_id, e.short_dd, e.long_dd, e.signal_bar, min(r.rn) AS hit FROM en e JOIN rw r ON e.event_id = r.event_id AND e.short_dd = r.short_dd AND e.long_dd = r.long_dd AND r.rn > e.entry_rn AND r.rn <= e.horizon
  AND ((e.direction = 'BUY' AND r.z >= 0) OR (e.direction = 'SELL' AND r.z <= 0)) GROUP BY ALL),
ex AS (SELECT e.event_id, e.short_dd, e.long_dd, e.signal_bar, e.direction, e.entry_rn, coalesce(h.hit, e.horizon) AS exit_rn, CASE WHEN h.hit IS NOT NULL THEN 'Z' WHEN e.horizon = e.entry_rn + 24 THEN 'T' ELSE 'P' END AS status
  FROM en e LEFT JOIN ht h USING (event_id, short_dd, long_dd, signal_bar))"""
)
FEE = "CASE WHEN {r} > 0 THEN {r} * pow({p} * (1 - {p}), {e}) ELSE 0 END"


def _fee(p: str, side: str) -> str:
    return FEE.format(p=p, r=f"l{side}.fee_rate", e=f"l{side}.fee_exp")


TRADES = (
    EXITS
    + ", "
    + LEGS
    + f""", t0 AS (SELECT x.event_id, x.short_dd, x.long_dd, x.signal_bar, x.direction, n.bar AS entry_bar, o.bar AS exit_bar, o.bar - n.bar AS hold,
    CASE WHEN x.status <> 'Z' AND (ls.resolution IS NOT NULL OR ll.resolution IS NOT NULL) THEN 'R' ELSE x.status END AS status,
    n.p_short AS p_short_entry, n.p_long AS p_long_entry, o.p_short, o.p_long, ls, ll
  FROM ex x JOIN rw n ON x.event_id = n.event_id AND x.short_dd = n.short_dd AND x.long_dd = n.long_dd AND n.rn = x.entry_rn
  JOIN rw o ON x.event_id = o.event_id AND x.short_dd = o.short_dd AND x.long_dd = o.long_dd AND o.rn = x.exit_rn
  LEFT JOIN legs ls ON ls.event_id = x.event_id AND ls.ladder_label = x.short_dd LEFT JOIN legs ll ON ll.event_id = x.event_id AND ll.ladder_label = x.long_dd),
t1 AS (SELECT *, CASE WHEN status = 'R' AND ls.resolution IS NOT NULL THEN ls.resolution ELSE p_short END AS p_short_exit, CASE WHEN status = 'R' AND ll.resolution IS NOT NULL THEN ll.resolution ELSE p_long END AS p_long_exit FROM t0),
t2 AS (SELECT event_id, short_dd, long_dd, signal_bar, direction, entry_bar, exit_bar, hold, status, p_short_entry, p_long_entry, p_short_exit, p_long_exit,
    coalesce(ls.market_spread + ll.market_spread, 0.04) + {_fee("p_long_entry", "l")} + {_fee("p_short_entry", "s")} + {_fee("p_long_exit", "l")} + {_fee("p_short_exit", "s")} AS cost FROM t1),
t3 AS (SELECT *, (CASE WHEN direction = 'BUY' THEN 1 ELSE -1 END) * ((p_long_exit - p_short_exit) - (p_long_entry - p_short_entry)) - cost AS pnl,
    row_number() OVER (PARTITION BY event_id, short_dd, long_dd ORDER BY signal_bar, direction) AS k FROM t2),
fold AS (SELECT event_id, short_dd, long_dd, k, true AS kept, exit_bar + 24 AS free FROM t3 WHERE k = 1
  UNION ALL SELECT t.event_id, t.short_dd, t.long_dd, t.k, t.signal_bar >= f.free, CASE WHEN t.signal_bar >= f.free THEN t.exit_bar + 24 ELSE f.free END
  FROM fold f JOIN t3 t ON t.event_id = f.event_id AND t.short_dd = f.short_dd AND t.long_dd = f.long_dd AND t.k = f.k + 1),
tr AS (SELECT t3.* EXCLUDE (k), pnl * 500 AS pnl_dollars FROM t3 JOIN fold USING (event_id, short_dd, long_dd, k) WHERE kept)"""
)
W = "WITH RECURSIVE "
BUCKETS = (
    TRADES
    + """, em AS (SELECT event_id, sum(liquidity) AS volume, string_split(arg_min(tags, ladder_order), ',')[1] AS primary_tag FROM legs GROUP BY 1),
b0 AS (SELECT tr.*, volume, primary_tag, greatest(deadline_date - (DATE '1970-01-01' + CAST(entry_bar // 24 AS INTEGER)), 1) AS tau FROM tr LEFT JOIN em USING (event_id) LEFT JOIN legs ON legs.event_id = tr.event_id AND legs.ladder_label = tr.short_dd),
b1 AS (SELECT quantile_cont(coalesce(volume, 0), [0.25, 0.5, 0.75]) AS cuts, count(DISTINCT volume) AS several FROM b0),
bk AS (SELECT b0.*, CASE WHEN tau <= 7 THEN '<=7d' WHEN tau <= 30 THEN '8-30d' WHEN tau <= 90 THEN '31-90d' WHEN tau <= 365 THEN '91-365d' WHEN tau <= 9999 THEN '>365d' END AS tau_bucket,
  CASE WHEN several >= 4 THEN CASE WHEN coalesce(volume, 0) <= cuts[1] THEN 'Q1-low' WHEN coalesce(volume, 0) <= cuts[2] THEN 'Q2' WHEN coalesce(volume, 0) <= cuts[3] THEN 'Q3' ELSE 'Q4-high' END END AS vol_q FROM b0, b1)"""
)
TRADE_COLS = ", ".join(["event_id", "short_dd", "long_dd", "signal_bar", "direction", "entry_bar", "exit_bar", "hold", "status"] + [f"round({c}, 9) AS {c}" for c in ("p_short_entry", "p_long_entry", "p_short_exit", "p_long_exit", "cost", "pnl", "pnl_dollars")])
SUMMARY = """count(*) AS n, count(*) FILTER (status = 'Z') AS n_z, count(*) FILTER (status = 'R') AS n_r, count(*) FILTER (status = 'T') AS n_t, count(*) FILTER (status = 'P') AS n_p, count(*) FILTER (status IN ('Z', 'R', 'T')) AS n_closed, round(sum(pnl), 9) AS total, round(avg(pnl), 9) AS mean,
  round(avg(CASE WHEN status IN ('Z', 'R', 'T') AND pnl <> 0 THEN (pnl > 0)::INT END), 9) AS hit, quantile_cont(hold::DOUBLE, 0.5) AS median_hold"""
STAT_COLS = "event_id, short_dd, long_dd, bar, round(spread, 9) AS spread, round(mu, 9) AS mu, round(sigma, 9) AS sigma, round(z, 6) AS z"


def _cols(df: DataFrame, *cols: str) -> DataFrame:
    return rounded(df.select(*cols))


STAT = ("event_id", "short_dd", "long_dd", "bar", "spread", "mu", "sigma", "z")


def _trades_summary_by(spark: SparkSession, d: str, column: str) -> DataFrame:
    return rounded(T.trade_summary(trades(spark, d), column))


def _walk_forward(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d)
    middle = t.agg(((F.min("entry_bar") + F.max("entry_bar")) / 2).alias("m")).scalar()
    return rounded(T.trade_summary(t.withColumn("half", F.when(F.col("entry_bar") <= middle, "first").otherwise("second")), "half"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """All reports in one pass: each trade is counted once for each of its segments."""
    t = T.trade_buckets(trades(spark, d), X.universe(spark, d))
    span = F.when(F.col("hold") <= 1, "0-1").when(F.col("hold") <= 7, "2-7").when(F.col("hold") <= 16, "8-16").otherwise("17+")
    named = {"direction": F.col("direction"), "status": F.col("status"), "primary_tag": F.col("primary_tag"), "vol_q": F.col("vol_q"), "tau_bucket": F.col("tau_bucket"), "pair": F.concat_ws("-", "short_dd", "long_dd"), "hold": span}
    parts = F.array(*[F.struct(F.lit(k).alias("segment"), v.alias("value")) for k, v in named.items()])
    each = t.withColumn("s", F.explode(parts)).select("*", "s.segment", "s.value").where((F.col("segment") != "vol_q") | F.col("value").isNotNull())
    return rounded(T.trade_summary(each, "segment", "value"), 7)


def _curve(spark: SparkSession, d: str) -> DataFrame:
    change = F.col("p_long_exit") - F.col("p_short_exit") - F.col("p_long_entry") + F.col("p_short_entry")
    mean = [F.avg(F.col(f"p_{s}_{w}") - (F.col("p_short_entry") + F.col("p_long_entry")) / 2).alias(f"{s}_{w}") for s in ("short", "long") for w in ("entry", "exit")]
    return rounded(trades(spark, d).groupBy("direction").agg(*mean, F.avg(change).alias("d_slope")))


def tokened(spark: SparkSession, d: str) -> DataFrame:
    """Unresolved legs with their market's tokens."""
    name = F.concat_ws("/", "event_id", "ladder_label")
    return X.universe(spark, d).where("resolution is null").withColumns({"yes_token": F.concat(name, F.lit("/Y")), "no_token": F.concat(name, F.lit("/N"))})


def _fees(spark: SparkSession, d: str) -> DataFrame:
    legs = X.universe(spark, d).withColumn("yes_token", F.concat_ws("/", "event_id", "ladder_label"))
    known = legs.where("event_id in ('click', 'view')").select(F.col("yes_token").alias("token"), F.when(F.col("event_id") == "click", 0.10).otherwise(0.05).alias("fee_rate"), F.when(F.col("event_id") == "click", 1.0).alias("fee_exp"))
    return G.fees_attach(legs, known).select("event_id", "ladder_label", "fee_rate", "fee_exp")


GAP = "(CAST(substr(long_dd, 2) AS DOUBLE) - CAST(substr(short_dd, 2) AS DOUBLE))"
QUERIES = {
    "price_points": lambda s, d: X.price_points(s, d).select("seq", "event_id", "ladder_order", "ladder_label", X.epoch_us(F.col("ts")).alias("us"), "p"),
    "bars_last": lambda s, d: P.bars_last(X.price_points(s, d)),
    "bars_ffill": filled,
    "panel_build": lambda s, d: P.panel_build(X.price_points(s, d), X.universe(s, d)),
    "tau_days": lambda s, d: P.panel_build(X.price_points(s, d), X.universe(s, d)).groupBy("event_id", "ladder_label").agg(F.min("tau_days").alias("least"), F.max("tau_days").alias("most")),
    "distinct_dates_having": lambda s, d: P.distinct_dates_having(X.universe(s, d), 3),
    "spread_panel": lambda s, d: rounded(S.spread_panel(filled(s, d).withColumn("ladder_type", F.lit("calendar")))),
    "spread_panel_types": lambda s, d: rounded(S.spread_panel(filled(s, d).withColumn("ladder_type", F.when(F.col("ladder_order") % 2 == 0, "calendar").otherwise("strike")))),
    "pair_intersection": lambda s, d: S.pair_intersection(filled(s, d)),
    "rolling_z": lambda s, d: _cols(stats(s, d), *STAT),
    "diff_rolling_z": lambda s, d: _cols(S.diff_rolling_z(spreads(s, d)), *STAT, "dS"),
    "latest_spread": lambda s, d: rounded(S.latest_spread(spreads(s, d))),
    "signals_rolling": lambda s, d: _cols(signals(s, d), *STAT, "direction"),
    "signals_diff": lambda s, d: _cols(G.signals_diff(S.diff_rolling_z(spreads(s, d))), *STAT, "dS", "direction"),
    "signals_diff_tau": lambda s, d: _cols(G.signals_diff(S.diff_rolling_z(S.spread_panel(P.tau_days(filled(s, d), X.universe(s, d)))), tau_min=45), *STAT, "dS", "direction", "tau_short"),
    "signals_latest": lambda s, d: _cols(G.signals_latest(signals(s, d), filled(s, d)), *STAT, "direction"),
    "signal_legs": lambda s, d: G.signal_legs(signals(s, d)),
    "universe_filter": lambda s, d: G.universe_filter(X.universe(s, d), exclude=["error"], volume=100.0, cap=0.007).select("event_id", "ladder_label", "liquidity"),
    "capacity_filter": lambda s, d: _cols(G.capacity_filter(signals(s, d), X.universe(s, d), cap=0.007), *PAIR, "bar", "direction", "cost", "edge"),
    "cost_attach": lambda s, d: _cols(G.cost_attach(signals(s, d), X.universe(s, d)), *PAIR, "bar", "cost", "max_leg"),
    "leg_cost_default": lambda s, d: _cols(G.leg_cost_default(signals(s, d), X.universe(s, d).where("ladder_order < 3")), *PAIR, "bar", "cost"),
    "leg_fee": lambda s, d: rounded(filled(s, d).join(X.universe(s, d).select("event_id", "ladder_label", "fee_rate", "fee_exp"), ["event_id", "ladder_label"]).select("event_id", "ladder_label", "bar", G.leg_fee(F.col("p"), F.col("fee_rate"), F.col("fee_exp")).alias("fee"))),
    "fees_attach": _fees,
    "trade_exit": lambda s, d: T.trade_exit(led_signals(s, d)),
    "trades_build": lambda s, d: rounded(trades(s, d)),
    "blotter": lambda s, d: _cols(trades(s, d), *PAIR, "direction", "entry_bar", "exit_bar", "p_short_entry", "p_long_entry", "p_short_exit", "p_long_exit", "pnl"),
    "trade_summary": lambda s, d: rounded(T.trade_summary(trades(s, d))),
    "segment_stats": _segments,
    "walk_forward": _walk_forward,
    "oos_split": lambda s, d: rounded(trades(s, d).groupBy((F.col("entry_bar") < 473800).alias("in_sample")).agg(F.count("*").alias("n"), F.avg("pnl").alias("mean"), T.tstat(F.col("pnl")).alias("t"))),
    "curve_shape": _curve,
    "equity_curve": lambda s, d: rounded(T.equity_curve(trades(s, d)), 8),
    "event_meta": lambda s, d: rounded(T.event_meta(X.universe(s, d)), 3),
    "trade_buckets": lambda s, d: rounded(T.trade_buckets(trades(s, d), X.universe(s, d)).select(*PAIR, "signal_bar", "primary_tag", "tau_bucket", "vol_q")),
    "top_trades": lambda s, d: rounded(T.top_trades(trades(s, d)).select("side", *PAIR, "signal_bar", "direction", "status", "pnl_dollars"), 6),
    "cooldown_fold": lambda s, d: trades(s, d).groupBy(*PAIR).agg(F.count("*").alias("n"), F.min("signal_bar").alias("first"), F.max("signal_bar").alias("last")),
    "cooldown_filter": lambda s, d: G.cooldown_filter(signals(s, d), trades(s, d).select(*PAIR, F.col("signal_bar").alias("bar")), span=12).select(*PAIR, "bar"),
    "signals_union": lambda s, d: signals(s, d).groupBy("event_id", "direction").agg(F.count("*").alias("n"), F.min("bar").alias("first"), F.max("bar").alias("last")),
    "legs_union_distinct": lambda s, d: G.signal_legs(signals(s, d)).groupBy("event_id").agg(F.count("*").alias("legs")),
    "event_mean_t": lambda s, d: rounded(trades(s, d).groupBy("event_id").agg(F.avg("pnl").alias("m")).agg(F.count("*").alias("n"), F.avg("m").alias("mean"), T.tstat(F.col("m"), 3).alias("t"))),
    "tstat": lambda s, d: rounded(trades(s, d).groupBy("event_id", "direction").agg(F.count("*").alias("n"), T.tstat(F.col("pnl")).alias("t"))),
}

SQL = {
    "price_points": f"WITH {EV} SELECT seq, event_id, ladder_order, ladder_label, epoch_us(ts) AS us, p FROM ev",
    "bars_last": f"WITH {EV} SELECT * FROM bars",
    "bars_ffill": f"WITH {FILLED} SELECT * FROM filled",
    "panel_build": f"WITH {EV}, {LEGS} SELECT event_id, b.ladder_order, ladder_label, bar, p, CAST(greatest(deadline_date - (DATE '1970-01-01' + CAST(floor(bar / 24.0) AS INTEGER)), 1) AS INTEGER) AS tau_days FROM bars b JOIN legs USING (event_id, ladder_label)",
    "tau_days": f"WITH {EV}, {LEGS}, t AS (SELECT event_id, ladder_label, CAST(greatest(deadline_date - (DATE '1970-01-01' + CAST(floor(bar / 24.0) AS INTEGER)), 1) AS INTEGER) AS tau FROM bars b JOIN legs USING (event_id, ladder_label)) SELECT event_id, ladder_label, min(tau) AS least, max(tau) AS most FROM t GROUP BY ALL",
    "distinct_dates_having": f"WITH {LEGS} SELECT event_id, count(DISTINCT deadline_date) AS n_dates FROM legs GROUP BY 1 HAVING n_dates >= 3",
    "spread_panel": f"WITH {SPREADS} SELECT event_id, 'calendar' AS ladder_type, short_dd, long_dd, bar, p_short, p_long, round(spread, 9) AS spread, {GAP} AS gap FROM sp",
    "spread_panel_types": f"WITH {SPREADS} SELECT event_id, CASE WHEN short_dd IN ('L0', 'L2') THEN 'calendar' ELSE 'strike' END AS ladder_type, short_dd, long_dd, bar, p_short, p_long, round(spread, 9) AS spread, {GAP} AS gap FROM sp WHERE {GAP} = 2",
    "pair_intersection": f"WITH {SPREADS} SELECT event_id, short_dd, long_dd, count(*) AS n, min(bar) AS first_bar, max(bar) AS last_bar FROM sp GROUP BY ALL HAVING count(*) >= 120",
    "rolling_z": f"WITH {STATS} SELECT {STAT_COLS} FROM st",
    "diff_rolling_z": f"WITH {DIFF} SELECT {STAT_COLS}, round(dS, 9) AS dS FROM dz",
    "latest_spread": f"WITH {SPREADS} SELECT event_id, short_dd, long_dd, round(arg_max(spread, bar), 9) AS spread, max(bar) AS bar FROM sp GROUP BY ALL",
    "signals_rolling": f"WITH {SIGNALS} SELECT {STAT_COLS}, direction FROM sg",
    "signals_diff": f"WITH {DIFF} SELECT event_id, short_dd, long_dd, bar, round(spread, 9) AS spread, round(spread - 0.5 * dS, 9) AS mu, round(sigma, 9) AS sigma, round(z, 6) AS z, round(dS, 9) AS dS, CASE WHEN z > 0 THEN 'SELL' ELSE 'BUY' END AS direction FROM dz WHERE sigma >= 0.002 AND abs(z) >= 2 AND abs(z) <= 6 AND spread >= 0",
    "signals_diff_tau": f"WITH {DIFF}, {LEGS}, t AS (SELECT dz.*, CAST(greatest(deadline_date - (DATE '1970-01-01' + CAST(floor(bar / 24.0) AS INTEGER)), 1) AS INTEGER) AS tau_short FROM dz JOIN legs ON legs.event_id = dz.event_id AND ladder_label = short_dd) SELECT event_id, short_dd, long_dd, bar, round(spread, 9) AS spread, round(spread - 0.5 * dS, 9) AS mu, round(sigma, 9) AS sigma, round(z, 6) AS z, round(dS, 9) AS dS, CASE WHEN z > 0 THEN 'SELL' ELSE 'BUY' END AS direction, tau_short FROM t WHERE sigma >= 0.002 AND abs(z) >= 2 AND abs(z) <= 6 AND spread >= 0 AND tau_short >= 45",
    "signals_latest": f"WITH {SIGNALS} SELECT {STAT_COLS}, direction FROM sg WHERE bar = (SELECT max(bar) FROM filled)",
    "signal_legs": f"WITH {SIGNALS} SELECT event_id, short_dd AS ladder_label FROM sg UNION SELECT event_id, long_dd FROM sg",
    "universe_filter": f"WITH {LEGS}, k AS (SELECT * FROM legs WHERE NOT list_contains(string_split(tags, ','), 'error') AND coalesce(liquidity, 100) >= 100 AND coalesce(market_spread, 0) <= 0.007) SELECT event_id, ladder_label, liquidity FROM k WHERE event_id IN (SELECT event_id FROM k GROUP BY 1 HAVING count(DISTINCT ladder_label) >= 2)",
    "capacity_filter": f"WITH {SIGNALS}, {LEGS}, j AS (SELECT g.*, a.market_spread + b.market_spread AS cost, abs(mu - spread) AS edge, greatest(a.market_spread, b.market_spread) AS mx FROM sg g JOIN legs a ON a.event_id = g.event_id AND a.ladder_label = short_dd JOIN legs b ON b.event_id = g.event_id AND b.ladder_label = long_dd) SELECT event_id, short_dd, long_dd, bar, direction, round(cost, 9) AS cost, round(edge, 9) AS edge FROM j WHERE edge >= 2 * cost AND mx <= 0.007",
    "cost_attach": f"WITH {SIGNALS}, {LEGS} SELECT g.event_id, short_dd, long_dd, bar, round(ls.market_spread + ll.market_spread + 2 * ({_fee('p_short', 's')} + {_fee('p_long', 'l')}), 9) AS cost, greatest(ls.market_spread, ll.market_spread) AS max_leg FROM sg g JOIN legs ls ON ls.event_id = g.event_id AND ls.ladder_label = short_dd JOIN legs ll ON ll.event_id = g.event_id AND ll.ladder_label = long_dd",
    "leg_cost_default": f"WITH {SIGNALS}, {LEGS}, l3 AS (SELECT * FROM legs WHERE ladder_order < 3) SELECT g.event_id, short_dd, long_dd, bar, round(coalesce(a.market_spread, 0.2) + coalesce(b.market_spread, 0.2), 9) AS cost FROM sg g LEFT JOIN l3 a ON a.event_id = g.event_id AND a.ladder_label = short_dd LEFT JOIN l3 b ON b.event_id = g.event_id AND b.ladder_label = long_dd",
    "leg_fee": f"WITH {FILLED}, {LEGS} SELECT event_id, ladder_label, bar, round({FEE.format(p='p', r='fee_rate', e='fee_exp')}, 9) AS fee FROM filled JOIN legs USING (event_id, ladder_label)",
    "fees_attach": f"WITH {LEGS} SELECT event_id, ladder_label, CASE event_id WHEN 'click' THEN 0.10::DOUBLE WHEN 'view' THEN 0.05 ELSE 0 END AS fee_rate, CASE event_id WHEN 'click' THEN 1.0::DOUBLE ELSE 0 END AS fee_exp FROM legs",
    "trade_exit": f"WITH {EXITS} SELECT * FROM ex",
    "trades_build": f"{W}{TRADES} SELECT {TRADE_COLS} FROM tr",
    "blotter": f"{W}{TRADES} SELECT event_id, short_dd, long_dd, direction, entry_bar, exit_bar, round(p_short_entry, 9) AS p_short_entry, round(p_long_entry, 9) AS p_long_entry, round(p_short_exit, 9) AS p_short_exit, round(p_long_exit, 9) AS p_long_exit, round(pnl, 9) AS pnl FROM tr",
    "trade_summary": f"{W}{TRADES} SELECT {SUMMARY} FROM tr",
    "segment_stats": f"""{W}{BUCKETS}, sgm AS (SELECT bk.*, unnest([{{'k': 'direction', 'v': direction}}, {{'k': 'status', 'v': status}}, {{'k': 'primary_tag', 'v': primary_tag}}, {{'k': 'vol_q', 'v': vol_q}}, {{'k': 'tau_bucket', 'v': tau_bucket}}, {{'k': 'pair', 'v': short_dd || '-' || long_dd}},
  {{'k': 'hold', 'v': CASE WHEN hold <= 1 THEN '0-1' WHEN hold <= 7 THEN '2-7' WHEN hold <= 16 THEN '8-16' ELSE '17+' END}}]) AS s FROM bk) SELECT s.k AS segment, s.v AS value, {SUMMARY.replace(", 9)", ", 7)")} FROM sgm WHERE s.k <> 'vol_q' OR s.v IS NOT NULL GROUP BY s.k, s.v""",
    "event_meta": f"WITH {LEGS} SELECT event_id, round(sum(liquidity), 3) AS volume, string_split(arg_min(tags, ladder_order), ',')[1] AS primary_tag FROM legs GROUP BY 1",
    "trade_buckets": f"{W}{BUCKETS} SELECT event_id, short_dd, long_dd, signal_bar, primary_tag, tau_bucket, vol_q FROM bk",
    "top_trades": f"{W}{TRADES}, w AS (SELECT 'winner' AS side, * FROM tr ORDER BY round(pnl_dollars, 6) DESC, event_id, short_dd, long_dd, signal_bar LIMIT 10), l AS (SELECT 'loser' AS side, * FROM tr ORDER BY round(pnl_dollars, 6), event_id, short_dd, long_dd, signal_bar LIMIT 10) SELECT side, event_id, short_dd, long_dd, signal_bar, direction, status, round(pnl_dollars, 6) AS pnl_dollars FROM (SELECT * FROM w UNION ALL SELECT * FROM l)",
    "walk_forward": f"{W}{TRADES}, m AS (SELECT (min(entry_bar) + max(entry_bar)) / 2.0 AS m FROM tr) SELECT CASE WHEN entry_bar <= (SELECT m FROM m) THEN 'first' ELSE 'second' END AS half, {SUMMARY} FROM tr GROUP BY 1",
    "oos_split": f"{W}{TRADES} SELECT entry_bar < 473800 AS in_sample, count(*) AS n, round(avg(pnl), 9) AS mean, CASE WHEN count(*) >= 8 THEN round(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(count(*)), 9) END AS t FROM tr GROUP BY 1",
    "curve_shape": f"{W}{TRADES} SELECT direction, round(avg(p_short_entry - (p_short_entry + p_long_entry) / 2), 9) AS short_entry, round(avg(p_short_exit - (p_short_entry + p_long_entry) / 2), 9) AS short_exit, round(avg(p_long_entry - (p_short_entry + p_long_entry) / 2), 9) AS long_entry, round(avg(p_long_exit - (p_short_entry + p_long_entry) / 2), 9) AS long_exit, round(avg(p_long_exit - p_short_exit - p_long_entry + p_short_entry), 9) AS d_slope FROM tr GROUP BY 1",
    "equity_curve": f"{W}{TRADES}, td AS (SELECT *, pnl_dollars::DECIMAL(28, 8) AS d FROM tr), k AS (SELECT event_id, row_number() OVER (ORDER BY sum(d) DESC, event_id) AS rk FROM td GROUP BY 1), b AS (SELECT exit_bar, sum(d) AS pnl, count(*) AS n, coalesce(sum(d) FILTER (rk > 1), 0) AS x1, coalesce(sum(d) FILTER (rk > 3), 0) AS x3 FROM td JOIN k USING (event_id) GROUP BY 1) SELECT exit_bar, round(pnl::DOUBLE, 8) AS pnl, n, round(sum(pnl) OVER (ORDER BY exit_bar)::DOUBLE, 8) AS equity, round(sum(x1) OVER (ORDER BY exit_bar)::DOUBLE, 8) AS equity_x1, round(sum(x3) OVER (ORDER BY exit_bar)::DOUBLE, 8) AS equity_x3 FROM b",
    "cooldown_fold": f"{W}{TRADES} SELECT event_id, short_dd, long_dd, count(*) AS n, min(signal_bar) AS first, max(signal_bar) AS last FROM tr GROUP BY ALL",
    "cooldown_filter": f"{W}{TRADES} SELECT event_id, short_dd, long_dd, bar FROM sg WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.event_id = sg.event_id AND tr.short_dd = sg.short_dd AND tr.long_dd = sg.long_dd AND sg.bar - tr.signal_bar BETWEEN 0 AND 11)",
    "signals_union": f"WITH {SIGNALS}, u AS (SELECT event_id, bar, 'BUY' AS direction FROM st WHERE sigma > 1e-6 AND z <= -1.75 AND mu - spread >= 0.05 UNION ALL SELECT event_id, bar, 'SELL' FROM st WHERE sigma > 1e-6 AND z >= 1.75 AND spread - mu >= 0.05) SELECT event_id, direction, count(*) AS n, min(bar) AS first, max(bar) AS last FROM u GROUP BY ALL",
    "legs_union_distinct": f"WITH {SIGNALS}, u AS (SELECT event_id, short_dd AS leg FROM sg UNION SELECT event_id, long_dd FROM sg) SELECT event_id, count(*) AS legs FROM u GROUP BY 1",
    "event_mean_t": f"{W}{TRADES}, e AS (SELECT event_id, avg(pnl) AS m FROM tr GROUP BY 1) SELECT count(*) AS n, round(avg(m), 9) AS mean, CASE WHEN count(*) >= 3 THEN round(avg(m) / nullif(stddev_samp(m), 0) * sqrt(count(*)), 9) END AS t FROM e",
    "tstat": f"{W}{TRADES} SELECT event_id, direction, count(*) AS n, CASE WHEN count(*) >= 8 THEN round(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(count(*)), 9) END AS t FROM tr GROUP BY ALL",
}

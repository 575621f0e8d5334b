"""Queries that write files or streams' inputs made of the tables, read them back, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import positions as O
from ..operators import universe as U
from ..sources import files, fixtures
from ..sources.shared import new_path, written
from ..streaming import streams
from . import ladder as L
from . import markets as M
from . import research as R
from .ladder import PAIR, rounded

def pair_key() -> Column:
    return F.concat_ws("|", *PAIR)


def ledger_files(spark: SparkSession, d: str) -> str:
    """A ledger of JSON lines made of orders, in order of keys, in a file for each status and remainder; every 997th line
    is cut off, every 101st blank."""
    key, total = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    closed = key % 4 == 0
    row = F.struct(
        F.col("o_custkey").cast("string").alias("event_id"), F.col("o_orderpriority").alias("short_dd"), F.col("o_orderstatus").alias("long_dd"),
        F.when(key % 2 == 0, "BUY").otherwise("SELL").alias("direction"), key.cast("string").alias("entry_ts"), total.alias("entry_spread"), (key % 7).cast("double").alias("z"),
        F.when(closed, "closed").otherwise("open").alias("status"), F.when(closed, total / 4).alias("pnl_c"),
    )
    line = F.when(key % 997 == 5, F.left(F.to_json(row), F.lit(25))).when(key % 101 == 7, F.lit(" ")).otherwise(F.to_json(row))
    rows = fixtures.table(spark, d, "orders").select(F.col("o_orderstatus").alias("kind"), (key % 8).alias("part"), key.alias("key"), line.alias("value"))
    path = new_path(spark, "ledger")
    rows.repartition("kind", "part").sortWithinPartitions("kind", "part", "key").drop("key").write.partitionBy("kind", "part").text(path)
    return path


LEDGER_COLS = ["event_id", "short_dd", "direction", "entry_ts", "entry_spread", "z", "status", "pnl_c"]


def claim_files(spark: SparkSession, d: str) -> str:
    """Claims as lines whose last field has commas, some quoted, with a header, in a folder for each category."""
    c = M.claims(spark, d).withColumn("category", F.substring_index("x", "/", 1))
    sign = F.when(F.col("sign") > 0, "+1").otherwise("-1")
    why = F.concat(F.lit("as "), F.col("x"), F.lit(" goes, so "), F.col("y"), F.lit(", or not"))
    line = F.concat_ws(",", "x", F.concat(F.lit(' "'), F.col("y"), F.lit('" ')), sign, F.lit(" strong"), why)
    head = c.select("category", F.lit("Underlying_A, underlying_b,sign,strength,rationale").alias("value")).distinct()
    path = new_path(spark, "claims")
    c.select("category", line.alias("value")).unionByName(head).write.partitionBy("category").text(path)
    return path


def exported(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "categories")
    files.category_export(U.underlyings(M.S.titles(spark, d)), path)
    return spark.read.option("header", True).schema("stem string, market_id long, volume double, n_markets long, rank int, category string").csv(path)


def streamed(df: DataFrame, make: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What a stream over the written ``df`` has given when it has read all of it."""
    spark = df.sparkSession
    source, out = written(df, name), new_path(spark, f"{name}-out")
    stream = make(spark.readStream.schema(df.schema).parquet(source.inputFiles()[0].rpartition("/")[0]))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, f"{name}-state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def bars_stream(spark: SparkSession, d: str) -> DataFrame:
    points = fixtures.price_points(spark, d).select("event_id", "ladder_label", F.col("ts").cast("timestamp").alias("ts"), "seq", "p")
    return streamed(points, streams.bars_stream, "bars").select("event_id", "ladder_label", fixtures.bar_of(F.col("bar_start")).alias("bar"), "p")


def fills_stream(spark: SparkSession, d: str) -> DataFrame:
    """Fills that arrive twice, as overlapping pages do."""
    f = fixtures.table(spark, d, "events").select(F.col("event_id").alias("fill_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("wallet"), F.round("value", 6).alias("size"))
    return streamed(f.unionByName(f), streams.fills_dedup_stream, "fills").select("fill_id", "wallet", "size")


def _signal_rows(spark: SparkSession, d: str) -> DataFrame:
    return L.signals(spark, d).select(pair_key().alias("key"), "bar", F.lit(1).alias("kind"), "direction", "spread")


def cooldown_stream(spark: SparkSession, d: str) -> DataFrame:
    return streamed(_signal_rows(spark, d), streams.signal_cooldown_stream, "cooldown")


def ledger_stream(spark: SparkSession, d: str) -> DataFrame:
    marks = L.spreads(spark, d).select(pair_key().alias("key"), "bar", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("direction"), "spread")
    return rounded(streamed(_signal_rows(spark, d).unionByName(marks), streams.ledger_stream, "ledger-events"))


def rolling_stream(spark: SparkSession, d: str) -> DataFrame:
    """Spreads in three batches of bars, each with the statistics that the bars before allow."""
    rows = written(L.spreads(spark, d).select(*PAIR, "bar", "spread"), "spread-bars")
    path, third = new_path(spark, "spread-batches"), rows.agg(F.min("bar").alias("a"), ((F.max("bar") - F.min("bar")) / 3 + 1).cast("long").alias("n"))
    at = rows.join(F.broadcast(third)).withColumn("batch", F.floor((F.col("bar") - F.col("a")) / F.col("n"))).drop("a", "n")  # one row
    for i in range(3):  # one file each, so that batches come in order
        at.where(F.col("batch") == i).drop("batch").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    history, sink = new_path(spark, "rolling-history"), new_path(spark, "rolling")
    streams.rolling_stream(stream, history, sink, window=L.WINDOW, min_obs=L.MIN_OBS, checkpoint=new_path(spark, "rolling-state")).awaitTermination()
    return rounded(spark.read.parquet(sink).select(*L.STAT))


def held_and_tracked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    found = written(R.detected(spark, d), "detected")
    extra = found.where("short_leg % 3 = 0").withColumn("direction", F.lit("NONE"))
    return found, found.where("short_leg % 2 = 0").unionByName(extra), ["event_id", "short_leg", "long_leg", "direction"]


def months(spark: SparkSession, d: str) -> DataFrame:
    q = M.S.questions(spark, d).select(F.regexp_extract("question", r"Will (\d)", 1).alias("category"), F.date_format("end_date", "yyyy-MM").alias("month"), "volume")
    return U.month_intersection(q.where("volume >= 100000"))


QUERIES = {
    "trades_sink": lambda s, d: rounded(files.trades_sink(L.trades(s, d), new_path(s, "trades"))),
    "ledger_read": lambda s, d: files.ledger_read(s, ledger_files(s, d)).select(LEDGER_COLS),
    "ledger_read_until_bad": lambda s, d: files.read_until_bad(s, ledger_files(s, d), files.LEDGER).select(*LEDGER_COLS, "kind", F.col("part").cast("long").alias("part")),
    "pairs_ragged_csv": lambda s, d: files.pairs_ragged_csv(s, claim_files(s, d)),
    "category_export": lambda s, d: rounded(exported(s, d), 2),
    "bars_stream": bars_stream,
    "fills_dedup_stream": fills_stream,
    "signal_cooldown_stream": cooldown_stream,
    "ledger_stream": ledger_stream,
    "rolling_stream": rolling_stream,
    "month_intersection": months,
    "adopt": lambda s, d: O.adopt(*held_and_tracked(s, d)),
    "drop": lambda s, d: O.drop(*held_and_tracked(s, d)),
}
BAD, BLANK = "o_orderkey % 997 = 5", "o_orderkey % 101 = 7"
LEDGER_SQL = "o_custkey::VARCHAR AS event_id, o_orderpriority AS short_dd, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS direction, o_orderkey::VARCHAR AS entry_ts, o_totalprice::DOUBLE AS entry_spread, (o_orderkey % 7)::DOUBLE AS z, CASE WHEN o_orderkey % 4 = 0 THEN 'closed' ELSE 'open' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice::DOUBLE / 4 END AS pnl_c"
COOLED = L.SIGNALS + R._fold("cd", "sg", "event_id, short_dd, long_dd", "bar", "bar + 12")
SQL = {
    "trades_sink": f"{L.W}{L.TRADES} SELECT {L.TRADE_COLS} FROM tr",
    "ledger_read": f"SELECT {LEDGER_SQL} FROM orders WHERE NOT ({BAD}) AND NOT ({BLANK})",
    "ledger_read_until_bad": f"WITH f AS (SELECT o_orderstatus AS k, o_orderkey % 8 AS p, min(o_orderkey) FILTER ({BAD}) AS stop FROM orders GROUP BY ALL) SELECT {LEDGER_SQL}, o_orderstatus AS kind, o_orderkey % 8 AS part FROM orders JOIN f ON k = o_orderstatus AND p = o_orderkey % 8 WHERE o_orderkey < coalesce(stop, 9223372036854775807) AND NOT ({BLANK})",
    "pairs_ragged_csv": f"WITH {L.LEGS}, l AS (SELECT event_id, event_id || '/' || ladder_label AS id FROM legs) SELECT a.id AS underlying_a, b.id AS underlying_b, CASE WHEN (length(a.id) + length(b.id)) % 2 = 0 THEN '+1' ELSE '-1' END AS sign, 'strong' AS strength, 'as ' || a.id || ' goes, so ' || b.id || ', or not' AS rationale, a.event_id AS category, CAST(CASE WHEN (length(a.id) + length(b.id)) % 2 = 0 THEN 1 ELSE -1 END AS INTEGER) AS sign_value FROM l a JOIN l b ON a.id < b.id",
    "category_export": f"WITH {M.UND} SELECT category, stem, market_id, round(volume, 2) AS volume, n_markets, rank FROM ur WHERE rank <= 150",
    "bars_stream": f"WITH {L.EV}, m AS (SELECT max(epoch_us(ts)) // 1000 * 1000 - 7200000000 AS mark FROM ev) SELECT event_id, ladder_label, bar, p FROM bars, m WHERE (bar + 1) * 3600000000 <= mark",
    "fills_dedup_stream": "SELECT event_id AS fill_id, user_id AS wallet, round(value, 6) AS size FROM events",
    "signal_cooldown_stream": f"{L.W}{COOLED} SELECT concat_ws('|', event_id, short_dd, long_dd) AS key, bar, direction FROM cd",
    "ledger_stream": f"{L.W}{R.LEDGER} SELECT concat_ws('|', event_id, short_dd, long_dd) AS key, entry_bar, direction, round(entry_spread, 9) AS entry_spread, exit_bar, round(exit_spread, 9) AS exit_spread, pnl_c FROM lg WHERE status = 'closed'",
    "rolling_stream": f"WITH {L.STATS} SELECT {L.STAT_COLS} FROM st",
    "adopt": f"{L.W}{R.DETECT} SELECT event_id, short_leg, long_leg, direction FROM de WHERE short_leg % 2 <> 0",
    "drop": f"{L.W}{R.DETECT} SELECT event_id, short_leg, long_leg, 'NONE' AS direction FROM de WHERE short_leg % 3 = 0",
    "month_intersection": "WITH q AS (SELECT DISTINCT substr(o_orderpriority, 1, 1) AS c, strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE o_totalprice >= 100000) SELECT a.c AS ca, b.c AS cb, a.month FROM q a JOIN q b ON a.month = b.month AND a.c < b.c",
}

"""Adapters from the star-schema tables to the engine's tables.

Time is counted in bars: ``bar`` is the number of whole bars since 1970-01-01, taken from timestamps without a zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 60
AS_OF = "2024-01-15"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_us(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def bar_of(ts: Column, minutes: int = HOUR) -> Column:
    return F.floor(epoch_us(ts) / F.lit(minutes * 60_000_000)).cast("long")


def price(value: Column) -> Column:
    return F.round(F.least(F.greatest(value / 500, F.lit(0.0)), F.lit(1.0)), 4)


def price_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, event_id, ladder_order, ladder_label, ts, p: one row a price point; event types are events, users legs."""
    order = (F.col("user_id") % 4).cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("event_id"), order.alias("ladder_order"), F.concat(F.lit("L"), order.cast("string")).alias("ladder_label"), "ts", price(F.col("value")).alias("p")
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a leg: spread, liquidity, tags, resolution, fee terms, deadline."""
    order = (F.col("user_id") % 4).cast("int")
    legs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("event_id"), order.alias("ladder_order")).agg(F.round(F.sum("value"), 4).alias("liquidity"), F.count("*").alias("n"))
    even = F.when(F.col("ladder_order") % 2 == 0, "even").otherwise("odd")
    return legs.select(
        "event_id",
        "ladder_order",
        F.concat(F.lit("L"), F.col("ladder_order").cast("string")).alias("ladder_label"),
        F.round(0.002 * (F.col("ladder_order") + 1), 4).alias("market_spread"),
        "liquidity",
        F.concat(F.col("event_id"), F.lit(","), even).alias("tags"),
        F.when((F.col("ladder_order") == 0) & (F.col("event_id") == "purchase"), 1.0).alias("resolution"),
        F.when(F.col("event_id") == "click", 0.10).otherwise(0.0).alias("fee_rate"),
        F.lit(1.0).alias("fee_exp"),
        F.date_add(F.lit("2024-03-01").cast("date"), F.col("ladder_order") * 30).alias("deadline_date"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only fills: wallet, asset, side, outcome, size, price, bar and second."""
    points = table(spark, sf_dir, "events")
    order = (F.col("user_id") % 4).cast("int")
    return points.select(
        F.col("event_id").alias("fill_id"),
        F.col("event_type").alias("event_id"),
        F.concat(F.lit("L"), order.cast("string")).alias("ladder_label"),
        F.col("user_id").alias("wallet"),
        F.when(F.col("event_id") % 2 == 0, "YES").otherwise("NO").alias("outcome"),
        F.when(F.floor(F.col("event_id") / 2) % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        F.col("value").alias("size"),
        price(F.col("value")).alias("price"),
        F.floor(epoch_us(F.col("ts")) / 1_000_000).cast("long").alias("sec"),
    )


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth levels: token, side, price, size."""
    ask = F.col("l_returnflag") == "A"
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("token"), F.when(ask, "ask").otherwise("bid").alias("side"), F.round(F.when(ask, 0.41 + 0.01 * F.col("l_linenumber")).otherwise(0.40 - 0.01 * F.col("l_linenumber")), 4).alias("price"), F.col("l_quantity").cast("double").alias("q")
    )
    return rows.groupBy("token", "side", "price").agg(F.sum("q").alias("size"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry clips of positions: key, direction, shares, spread, leg costs, day, sequence."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_suppkey").alias("event_id"), F.when(F.col("l_returnflag") == "A", "BUY").otherwise("SELL").alias("direction"), F.col("l_quantity").cast("double").alias("shares"), F.col("l_discount").cast("double").alias("spread"),
        F.datediff(F.col("l_shipdate"), F.lit("1970-01-01").cast("date")).alias("day"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"),
    )


def event_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as legs of their nation's event, ordered by key."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_nationkey").alias("event_id"), F.col("s_suppkey").alias("leg"), F.concat(F.lit("Y"), F.col("s_suppkey").cast("string")).alias("yes"), F.concat(F.lit("N"), F.col("s_suppkey").cast("string")).alias("no"))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, size, avg_price held: alternate outcomes of suppliers, sizes from shipped quantities."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("double")).alias("size"))
    token = F.concat(F.when(F.col("l_suppkey") % 2 == 0, "Y").otherwise("N"), F.col("l_suppkey").cast("string"))
    return rows.select(token.alias("token"), "size", F.lit(0.4).alias("avg_price"))


def market_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("market_id"), F.col("source").alias("event_id"), F.col("lang").alias("category"), "text", F.split("text", "\n")[0].alias("question"), F.col("n_chars").cast("double").alias("volume"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadline questions made of orders: full dates, dates without year, or only a year."""
    o = table(spark, sf_dir, "orders")
    when = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("before "), F.year("o_orderdate").cast("string"))).when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("by "), F.date_format("o_orderdate", "MMMM d"))).otherwise(F.concat(F.lit("by "), F.date_format("o_orderdate", "MMMM d, yyyy")))
    return o.select(F.col("o_orderkey").alias("market_id"), F.col("o_custkey").alias("event_id"), F.concat(F.lit("Will "), F.col("o_orderpriority"), F.lit(" order close "), when, F.lit("?")).alias("question"), F.col("o_totalprice").cast("double").alias("volume"), F.col("o_orderdate").cast("date").alias("end_date"), F.col("o_orderstatus").alias("status"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market_id, event_id, status and a title of ten kinds made of orders: dates and amounts written in many ways, and words
    that only look like them."""
    o = table(spark, sf_dir, "orders")
    at = lambda form: F.date_format("o_orderdate", form)
    year, p, clerk = F.year("o_orderdate").cast("string"), F.col("o_orderpriority"), F.concat(F.lit("Clerk#"), F.col("o_custkey").cast("string"))
    n = F.col("o_orderkey")
    kinds = [
        F.concat(F.lit("Will the market decide on a novel marathon by "), at("MMMM d, yyyy"), F.lit("?")),
        F.concat(p, F.lit(" reaches $5000 in 1999 shares before "), at("MMM"), F.lit(". "), at("d"), F.lit("th, "), year),
        F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" 2024 revenue of "), clerk, F.lit(" above 1,200.5 million - by end of 2025.")),
        F.concat(F.lit("GDP under 2.5% on "), at("M/d/yyyy"), F.lit(", says "), p),
        F.concat(F.lit("\u201c"), clerk, F.lit("\u201d (High) reaches $1.6T in "), at("MMMM"), F.lit(" 2026")),
        F.concat(F.lit("Will "), p, F.lit(" be over $"), (n % 1000).cast("string"), F.lit(",000 after "), at("MMMM"), F.lit("?")),
        F.concat(clerk, F.lit(" through 2026, at least 3 thousand units until")),
        F.concat(F.lit("Moreover, thunder in 2031 by May 5th and at 12,2027 for "), p),
        F.lit(" ?"),
        F.concat(F.lit("Will (the 5) 1,550 of \u2018"), p, F.lit("\u2019 GPT-5 \u201c1550\u201d win at Omar 5?")),
    ]
    text = kinds[-1]
    for i, kind in enumerate(kinds[:-1]):
        text = F.when(n % 10 == i, kind).otherwise(text)
    return o.select(n.alias("market_id"), F.col("o_custkey").alias("event_id"), text.alias("question"), F.col("o_totalprice").cast("double").alias("volume"), F.col("o_orderstatus").alias("category"))


def event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested event documents made of orders: a customer's orders are the markets of its event."""
    q = questions(spark, sf_dir)
    key = F.col("market_id").cast("string")
    names = F.when(F.col("market_id") % 3 == 0, F.lit('["No"," Yes "]')).when(F.col("market_id") % 11 == 0, F.lit('["Yes"]')).otherwise(F.lit('["Yes","No"]'))
    prices = F.when(F.col("status") == "F", F.lit('["1","0"]')).when(F.col("status") == "O", F.lit('["0.5","0.5"]')).otherwise(F.lit('["0","1"]'))
    market = F.struct(
        F.col("market_id").alias("id"), F.concat(F.lit("m-"), (F.col("market_id") % 5000).cast("string")).alias("slug"), "question", F.concat(F.lit("Resolves by "), key).alias("description"), F.col("end_date").cast("string").alias("endDate"), names.alias("outcomes"),
        F.concat(F.lit('["A'), key, F.lit('","B'), key, F.lit('"]')).alias("clobTokenIds"), prices.alias("outcomePrices"), "volume", (F.col("volume") / 2).alias("liquidity"), (F.col("market_id") % 7 / 100).alias("spread"), (F.col("market_id") % 4 == 0).alias("negRisk"), F.when(F.col("market_id") % 6 == 0, 0.001).alias("orderPriceMinTickSize"),
    )
    each = q.groupBy(F.col("event_id").alias("id")).agg(F.sort_array(F.collect_list(market)).alias("markets"), F.sum("volume").alias("volume"))  # one customer's orders
    kind = F.when(F.col("id") % 13 == 0, "Red vs Blue, by date").when(F.col("id") % 17 == 0, "Orders").otherwise(F.concat(F.lit("Orders of "), F.col("id").cast("string"), F.lit(" by date")))
    label = lambda slug, name: F.struct(slug.cast("string").alias("slug"), name.cast("string").alias("label"))
    tags = F.array_compact(F.array(label(F.concat(F.lit("Zone-"), (F.col("id") % 5).cast("string")), F.lit("Zone")), F.when(F.col("id") % 2 == 0, label(F.lit(None), F.lit("Even")))))
    return each.select("id", kind.alias("title"), tags.alias("tags"), "volume", (F.col("volume") / 10).alias("liquidity"), "markets")

"""Leg and market dimensions from nested event documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import deadline, strip_dates, strip_thresholds


def token_extract(markets: DataFrame) -> DataFrame:
    """yes_token and no_token from the JSON arrays ``outcomes`` and ``tokens`` of equal length; a later match wins."""
    names, ids = F.from_json("outcomes", "array<string>"), F.from_json("tokens", "array<string>")
    pairs = F.when(F.size(names) == F.size(ids), F.arrays_zip(names.alias("name"), ids.alias("id")))
    last = lambda which: F.try_element_at(F.filter(pairs, lambda p: F.lower(F.trim(p["name"])) == which), F.lit(-1))["id"]
    return markets.withColumns({"yes_token": last("yes"), "no_token": last("no")})


def resolution_flag(prices: Column) -> Column:
    """The first outcome's price if it is exactly 0 or 1."""
    first = F.try_element_at(F.from_json(prices, "array<string>"), F.lit(1)).try_cast("double")
    return F.when(first.isin(0.0, 1.0), first)


def looks_one_off(text: Column) -> Column:
    """A match between two sides: case matters."""
    return F.contains(text, F.lit(" vs ")) | F.contains(text, F.lit(" vs. "))


def question_filters(markets: DataFrame) -> DataFrame:
    """Questions with a deadline's phrase that aren't matches, of events, where these have a title, that has "by" in it and
    isn't a match either."""
    low = F.lower("question")
    held = markets.where((F.contains(low, F.lit(" by ")) | F.contains(low, F.lit("before "))) & ~looks_one_off(F.col("question")))
    if "title" in markets.columns:
        held = held.where(F.contains(F.lower("title"), F.lit("by")) & ~looks_one_off(F.col("title")))
    return held


def explode_events(events: DataFrame) -> DataFrame:
    """One row a market of nested event documents, numbered by seq within its event, with the event's title, tags (slugs,
    else labels, in lower case, comma-separated), primary tag, volume and liquidity."""
    slug = lambda t: F.lower(F.coalesce(F.nullif(t["slug"], F.lit("")), t["label"]))
    tags = F.filter(F.transform(F.coalesce("tags", F.array().cast(events.schema["tags"].dataType)), slug), lambda t: t.isNotNull() & (t != ""))
    rows = events.select(F.col("id").alias("event_id"), "title", F.array_join(tags, ",").alias("tags"), F.coalesce(F.get(tags, F.lit(0)), F.lit("")).alias("primary_tag"), F.col("volume").try_cast("double").alias("event_volume"), F.col("liquidity").try_cast("double").alias("event_liquidity"), F.posexplode("markets").alias("seq", "m"))
    number = lambda c: F.col(f"m.{c}").try_cast("double")
    return rows.select(
        "event_id", "title", "tags", "primary_tag", "event_volume", "event_liquidity", "seq", F.col("m.id").alias("market_id"), F.col("m.slug").alias("slug"), F.col("m.question").alias("question"), F.trim("m.description").alias("criteria"), F.col("m.endDate").try_cast("date").alias("end_date"), F.col("m.outcomes").alias("outcomes"), F.col("m.clobTokenIds").alias("tokens"),
        resolution_flag(F.col("m.outcomePrices")).alias("resolution"), number("volume").alias("market_volume"), number("liquidity").alias("market_liquidity"), number("spread").alias("market_spread"), F.coalesce("m.negRisk", F.lit(False)).alias("neg_risk"), F.coalesce(F.nullif(number("orderPriceMinTickSize"), F.lit(0.0)), F.lit(0.01)).alias("min_tick"),
    )


LEG_COLUMNS = ("tags", "event_volume", "event_liquidity", "market_id", "question", "yes_token", "no_token", "resolution", "market_volume", "market_liquidity", "market_spread", "neg_risk", "min_tick")


def universe_build(events: DataFrame, as_of: Column, *, least_dates: int = 2) -> DataFrame:
    """One row an event and deadline of nested event documents, the last market of each, for events with ``least_dates``
    deadlines."""
    held = token_extract(question_filters(explode_events(events)))
    held = held.withColumn("deadline_date", F.coalesce(deadline(F.col("question"), as_of), F.col("end_date"))).where("deadline_date is not null and yes_token is not null")
    last = held.groupBy("event_id", "title", "deadline_date").agg(F.max_by(F.struct(*LEG_COLUMNS), "seq").alias("m")).select("event_id", "title", "deadline_date", "m.*")
    counts = last.groupBy("event_id", "title").agg(F.count("*").alias("n_dates")).where(F.col("n_dates") >= least_dates)
    order = (F.datediff("deadline_date", F.lit("0001-01-01").cast("date")) + 1).cast("double")
    return last.join(counts, ["event_id", "title"]).select("event_id", "title", "deadline_date", F.lit("calendar").alias("ladder_type"), order.alias("ladder_order"), F.col("deadline_date").cast("string").alias("ladder_label"), "n_dates", *LEG_COLUMNS)


def market_rows(events: DataFrame) -> DataFrame:
    """One row a slug of nested event documents, its last market, of those with slug and criteria."""
    held = token_extract(explode_events(events)).where("slug <> '' and criteria <> ''")
    columns = ("event_id", "title", "market_id", "question", "criteria", "tags", "primary_tag", "neg_risk", "yes_token", "no_token", "market_volume", "market_liquidity", "event_volume")
    last = held.groupBy("slug").agg(F.max_by(F.struct(*columns), F.struct("event_id", "seq")).alias("m"))
    return last.select("slug", "m.*")


def category_assign(rows: DataFrame, categories: list[tuple[str, list[str]]]) -> DataFrame:
    """The first category whose tags meet the row's; rows of none go."""
    tags = F.split("tags", ",")
    found = F.coalesce(*[F.when(F.arrays_overlap(tags, F.array(*map(F.lit, t))), F.lit(name)) for name, t in categories])
    return rows.withColumn("category", found).where("category is not null")


def tag_groups(rows: DataFrame, *, exclude: list[str], least: int, only: list[str] | None = None, primary: bool = False) -> DataFrame:
    """Rows without an excluded tag, by each of their tags or by the first one, in groups of at least ``least``; with
    ``only``, rows and groups of these tags alone."""
    tags = F.split("tags", ",")
    held = rows.where(~F.arrays_overlap(tags, F.array(*map(F.lit, exclude)))) if exclude else rows
    if only:
        held = held.where(F.arrays_overlap(tags, F.array(*map(F.lit, only))))
    held = held.withColumn("tag", tags[0] if primary else F.explode(tags)).where("tag <> ''")
    held = held.where(F.col("tag").isin(only)) if only else held
    sizes = held.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return held.join(sizes, "tag")


def collapse_exclusive(markets: DataFrame) -> DataFrame:
    """One row an event: first question, longest text, number of outcomes, volume."""
    return markets.groupBy("event_id").agg(F.min_by("question", "market_id").alias("question"), F.max_by("text", F.struct(F.length("text"), -F.col("market_id"))).alias("text"), F.count("*").alias("n_outcomes"), F.sum("volume").alias("volume"))


def _stemmed(markets: DataFrame) -> DataFrame:
    """stem without dates, and alone: the market's id where nothing is left of its question, which then stands alone."""
    held = markets.withColumn("stem", strip_dates(F.col("question")))
    return held.withColumn("alone", F.when(F.col("stem") == "", F.col("market_id")))


def collapse_calendar(markets: DataFrame) -> DataFrame:
    """One row a stem without dates, with an id of its own where several markets share it."""
    several = F.concat(F.lit("cal::"), F.left(F.md5(F.col("stem").cast("binary")), F.lit(10)))
    each = _stemmed(markets).groupBy("stem", "alone").agg(F.count("*").alias("n_dates"), F.min("market_id").alias("first"))
    return each.select("stem", "n_dates", "first", F.when(F.col("n_dates") > 1, several).otherwise(F.col("first").cast("string")).alias("id"))


def calendar_mapping(markets: DataFrame) -> DataFrame:
    """market_id and the id of the node that it went into."""
    held, nodes = _stemmed(markets), collapse_calendar(markets)
    alone = held.where("stem = ''").select("market_id", F.col("market_id").cast("string").alias("id"))
    return held.where("stem <> ''").join(nodes.select("stem", "id"), "stem").select("market_id", "id").unionByName(alone)


def underlyings(markets: DataFrame, *, n: int = 150) -> DataFrame:
    """One row a category and stem without dates and thresholds: its best market by volume; the ``n`` largest a category."""
    held = markets.withColumn("stem", strip_thresholds(strip_dates(F.col("question")))).where("stem <> ''")
    each = held.groupBy("category", "stem").agg(F.max_by("market_id", F.struct("volume", -F.col("market_id"))).alias("market_id"), F.max("volume").alias("volume"), F.count("*").alias("n_markets"))
    best = Window.partitionBy("category").orderBy(F.desc("volume"), "stem")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def market_universe(markets: DataFrame) -> DataFrame:
    """The last market of each slug, of those with slug and text."""
    held = markets.where("slug <> '' and text is not null and text <> ''")
    return held.groupBy("slug").agg(F.max_by(F.struct("market_id", "category"), "market_id").alias("m")).select("slug", "m.*")


def month_intersection(rows: DataFrame) -> DataFrame:
    """ca, cb, month: the months in which two categories (ca before cb) both have a row (category, month)."""
    held = rows.select("category", "month").distinct()
    other = held.select("month", F.col("category").alias("cb"))
    return held.withColumnRenamed("category", "ca").join(other, "month").where("ca < cb").select("ca", "cb", "month")

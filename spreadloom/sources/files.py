"""Readers and writers of the engine's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of a ledger's and of a pair file's columns, and the header that a pair file may begin with.
LEDGER = "event_id string, short_dd string, long_dd string, direction string, entry_ts string, entry_spread double, z double, status string, exit_ts string, exit_spread double, pnl_c double"


def ledger_read(spark: SparkSession, path: str) -> DataFrame:
    """A ledger of JSON lines; blank and malformed ones are skipped."""
    return spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(path)


def read_until_bad(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of each file down to its first bad one (no JSON object, or a value of another type); blank lines are
    skipped. The columns of ``schema``, those of the folders and ``file``.

    A line's place is where its split of the file begins and its number within the task that reads it, which grows along
    a split. So a file may be read by many tasks: each finds its first bad place, the smallest of a file's counts, and
    lines before it stay. Only one row a file is shuffled.
    """
    corrupt = "__corrupt"
    at = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path)
    lines = lines.select(*lines.columns, F.col("_metadata.file_path").alias("file"), at.alias("__at")).where(F.trim("value") != "")
    row = F.from_json("value", f"{schema}, {corrupt} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    lines = lines.withColumn("__row", row).withColumn("__bad", F.col("__row").isNull() | F.col(f"__row.{corrupt}").isNotNull())
    first = lines.groupBy("file").agg(F.min(F.when(F.col("__bad"), F.col("__at"))).alias("__first"))
    kept = lines.join(first, "file").where(F.col("__first").isNull() | (F.col("__at") < F.col("__first")))
    return kept.select("__row.*", *[c for c in lines.columns if c not in ("value", "__at", "__row", "__bad")]).drop(corrupt)


def pairs_ragged_csv(spark: SparkSession, path: str) -> DataFrame:
    """Claims (a, b, sign, strength, rationale) whose last field may hold commas. Blanks and quotes around a field are cut,
    missing fields are empty, blank lines and a header are left out; the category is that of the folder, else the file's name. ``sign`` is as
    written, ``sign_value`` 1 or -1 by its first character."""
    place = F.input_file_name()
    category = F.coalesce(F.nullif(F.regexp_extract(place, "/category=([^/]+)/", 1), F.lit("")), F.regexp_extract(place, r"([^/]+)\.csv$", 1))
    rows = spark.read.text(path).select(category.alias("category"), "value")
    header = F.startswith(F.regexp_replace(F.lower("value"), " ", ""), F.lit("underlying_a"))
    rows = rows.where((F.trim("value") != "") & ~header).withColumn("p", F.split("value", ",", 5))
    field = lambda i: F.trim(F.btrim(F.trim(F.coalesce(F.get("p", F.lit(i)), F.lit(""))), F.lit('"')))
    names = ["underlying_a", "underlying_b", "sign", "strength", "rationale"]
    sign = F.when(F.startswith("sign", F.lit("+")), 1).when(F.startswith("sign", F.lit("-")), -1)
    return rows.select(*[field(i).alias(n) for i, n in enumerate(names)], "category").withColumn("sign_value", sign)


def category_export(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("category").option("header", True).csv(path)


def trades_sink(trades: DataFrame, path: str) -> DataFrame:
    trades.write.mode("overwrite").parquet(path)
    return trades.sparkSession.read.schema(trades.schema).parquet(path)

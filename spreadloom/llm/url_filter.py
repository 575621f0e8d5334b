"""URL rules: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A rule is (verdict, host, path prefix). It fits its host and all subdomains if the url's path starts with its prefix;
the longest fitting rule (host and path together, then the longer host) decides. A url's possible keys are its host
suffixes with the path prefixes of those lengths that rules have. Each key is looked up in the filter, a table of
64-byte blocks; only keys that it passes reach the exact join, which removes its false positives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
WORDS, PROBES = 8, 8  # 64-bit words in a block; bits a key sets, all in one block
MAX_BLOCKS = 1 << 15  # 2 MB of filter, the bound of what is broadcast; a longer list only raises false positives
KEYS_PER_BLOCK = 32  # 16 bits a key


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"\A[^/?#]*", 0)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def _bits(key: Column) -> tuple[Column, Column, list[Column]]:
    """Block number's hash, and for each probe the word and bit that the key uses."""
    h = F.xxhash64(key, F.lit(1))
    g = F.xxhash64(key, F.lit(2))
    words = [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(WORDS - 1)) for i in range(PROBES)]
    bits = [F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)) for i in range(PROBES)]
    return F.xxhash64(key), words, bits


def _mask(words: list[Column], bits: list[Column], word: int) -> Column:
    mask = F.lit(0).cast("long")
    for w, b in zip(words, bits, strict=True):
        mask = mask.bitwiseOR(F.when(w == word, F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int"))).otherwise(F.lit(0).cast("long")))
    return mask


def bloom_table(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """One row a block that holds a key: its number and words w0..w7."""
    block, words, bits = _bits(F.col(key))
    masks = keys.select(F.pmod(block, F.lit(n_blocks)).alias("block"), *[_mask(words, bits, i).alias(f"w{i}") for i in range(WORDS)])
    return masks.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def filter_urls(pages: DataFrame, rules: DataFrame, *, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    A url that is null or has no ``://`` has empty host and path and fits no rule; no rule: verdict ``otherwise`` and a
    null rule. Repeated pages each get a row; repeated rules count once, and of equal rules with different verdicts
    ``block`` wins. Other columns of ``pages`` are ignored. An empty list lets everything pass.
    """
    rules = rules.where("rule_host is not null and rule_path is not null").groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    keyed = rules.withColumn("key", F.concat_ws("\x00", "rule_host", "rule_path"))
    lengths = rules.agg(F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"), F.count("*").alias("n")).first()  # distinct lengths of prefixes
    if not lengths["n"]:
        lengths = {"lengths": [], "n": 0}
    n_blocks = max(1, min(MAX_BLOCKS, -(-lengths["n"] // KEYS_PER_BLOCK)))
    host, path = host_and_path(F.col("url"))
    judged = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    # a key is looked up once for each distinct host and path, so a hot host meets no join with all its pages' urls
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    sizes = F.array(*[F.lit(n) for n in lengths["lengths"]]).cast("array<int>")
    keys = judged.select("host", "path").where("host <> ''").distinct()
    keys = keys.withColumn("suffix", F.explode(suffixes)).withColumn("size", F.explode(F.filter(sizes, lambda n: n <= F.length("path"))))
    keys = keys.withColumn("key", F.concat_ws("\x00", "suffix", F.expr("left(path, size)")))
    block, words, bits = _bits(F.col("key"))
    keys = keys.withColumn("block", F.pmod(block, F.lit(n_blocks)))
    hit = F.lit(True)
    for i in range(WORDS):
        mask = _mask(words, bits, i)
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    possible = keys.join(F.broadcast(bloom_table(keyed, "key", n_blocks)), "block").where(hit)
    found = possible.select("host", "path", "key").join(keyed, "key")
    best = found.groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))).alias("best")
    )
    return judged.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rules_frame(spark))


SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(verdict, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits AS (
  SELECT page_id, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(r.verdict, length(h) + length(p)) AS verdict
  FROM parts JOIN rules r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""

"""Near-duplicate lines by an exact set-similarity join, in DataFrame functions only.

A line's set is its distinct lower-cased tokens. Tokens are numbers: a level of rarity in the top bits, from counts over
all documents in ``SLOTS`` slots, then 58 bits of hash; sorting a line's tokens puts the rare ones first. Any fixed
order makes the join exact, so the bounded table of counts only decides how well it prunes. Two sets with Jaccard
similarity t share a token among the first n - ceil(t n) + 1 of each (prefix filter), have sizes within t of each other (length filter),
cannot gain more tokens than follow the shared one (positional filter), and differ in no more of their first tokens than
the sets can (summaries of the first ``WINDOW``, of the prefix and, of lines of more, two of all tokens; a differing bit
is a differing token). What passes is verified on the whole sets.

A line is removed if an earlier line, by doc_id and then line number, has similarity of at least ``THRESHOLD``; equal
sets have 1 and are one class from the start. Classes meet in the buckets of their prefix tokens in two rounds. First
each is compared with a bucket's earliest member alone, which settles nearly all of a family of variants with a pair a
member. Only classes that this leaves are joined with all members before them. Buckets of tokens that more than ``HOT``
words are, by the table of counts, are dealt over several tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, named, table, written

THRESHOLD = 0.85
SLOTS = 1 << 16  # counts of tokens by hash: a constant of so many numbers, whatever the number of tokens
HASH = (1 << 58) - 1
WINDOW = 24  # tokens in a summary of 64 bits
HOT = 1_000_000
BROADCAST_ROWS = 100_000  # documents with some of their line numbers; more of them are joined by a shuffle
OTHER_SPACE = "[\\t\\x0B\\f\\r]"  # white space in a line, the blank aside


def split_lines(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "line"))


def words(line: Column) -> Column:
    """Lower-case words between white space; empty strings may stand among them."""
    low = F.lower(line)
    return F.when(F.rlike(low, F.lit(OTHER_SPACE)), F.split(low, f"(?:{OTHER_SPACE}| )")).otherwise(F.split(low, " "))  # a plain blank is split without a pattern


def rarity(lines: DataFrame) -> tuple[Column, int]:
    """The level of each slot as an array: 0 if it has met one token at most, else 1 (rarest) to 31 by its share of all
    tokens; and the first level of hot tokens. The driver gets ``SLOTS`` counts at most."""
    slots = lines.select(F.explode(words(F.col("line"))).alias("w")).select(F.pmod(F.xxhash64("w"), F.lit(SLOTS)).cast("int").alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
    found = slots.toArrow()
    counts = np.zeros(SLOTS)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    total = max(1.0, counts.sum())
    levels = np.floor(31 + np.log2(np.maximum(counts, 1) / total))
    levels = np.where(counts <= 1, 0, np.clip(levels, 1, 31)).astype(int)
    hot = int(np.clip(np.floor(31 + np.log2(HOT / total)), 1, 32))
    return F.split(F.lit(",".join(map(str, levels))), ",").cast("array<int>"), hot  # folded into one constant


def token_sets(lines: DataFrame, levels: Column) -> DataFrame:
    """The columns of ``lines`` but its text, and tokens (sorted) of those that have one."""
    # never null, so that Spark sorts plain numbers
    token = lambda h: F.shiftleft(F.coalesce(F.get(levels, h.bitwiseAND(F.lit(SLOTS - 1)).cast("int")), F.lit(0)).cast("long"), 58).bitwiseOR(h.bitwiseAND(F.lit(HASH)))
    hashes = F.array_distinct(F.transform(F.array_remove(words(F.col("line")), ""), lambda w: F.xxhash64(w)))
    rest = [c for c in lines.columns if c != "line"]
    # asked of the line, as a filter on the set would have it made twice
    return lines.where(F.rlike("line", F.lit("[^ \\t\\x0B\\f\\r]"))).select(*rest, F.sort_array(F.transform(hashes, token)).alias("tokens"))


def keys() -> list[Column]:
    """k1, k2: 128 bits that stand for a set."""
    return [F.xxhash64("tokens").alias("k1"), F.xxhash64(F.lit(7), "tokens").alias("k2")]


def summary(tokens: str, shift: int) -> Column:
    """64 bits of the first ``WINDOW`` tokens, each of which turns one bit over."""
    bit = "coalesce(shiftleft(1L, cast(shiftright(get({}, {}), {}) & 63L as int)), 0L)"
    return F.expr(" ^ ".join(bit.format(tokens, i, shift) for i in range(WINDOW)))


def wide_summary(shift: int) -> Column:
    """64 bits of all tokens of a line of more than ``WINDOW``, 0 for others."""
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    bit = lambda t: F.call_function("shiftleft", one, F.shiftright(t, shift).bitwiseAND(F.lit(63)).cast("int"))
    return F.when(F.size("tokens") > WINDOW, F.aggregate("tokens", none, lambda s, t: s.bitwiseXOR(bit(t)))).otherwise(none)


def least_overlap(a: Column, b: Column, threshold: float) -> Column:
    return F.ceil((a + b) * F.lit(threshold / (1 + threshold)) - 1e-9)


def pairs_up(n: Column, threshold: float) -> Column:
    """Whether a set of ``n`` tokens can be similar to one that differs: of another size, or of its own with fewer shared."""
    return (F.floor(n / F.lit(threshold) + 1e-9) > n) | (F.ceil(F.lit(threshold) * n - 1e-9) < n) | (least_overlap(n, n, threshold) < n)


def passes(x: str, y: str, threshold: float) -> Column:
    """Whether the sets of two postings, named by suffixes, can be similar: lengths, positions and summaries. Sets that
    lack a and b tokens of each other differ in a + b; first windows of one length lack max(a, b) of each other at most."""
    of = lambda c: (F.col(c + x), F.col(c + y))
    (nx, ny), (px, py) = of("n"), of("pos")
    need = least_overlap(nx, ny, threshold)
    most = 2 * (F.greatest(nx, ny) - need)
    size = {"low": lambda n: F.least(n, F.lit(WINDOW)), "second": lambda n: F.least(prefix_size(n, threshold), F.lit(WINDOW))}
    differ = lambda c: F.bit_count(F.col(c + x).bitwiseXOR(F.col(c + y))) <= most + F.abs(size[c](nx) - size[c](ny))
    both, none = F.least(nx, ny) > WINDOW, F.greatest(nx, ny) <= WINDOW
    whole = lambda c: F.bit_count(F.col(c + x).bitwiseXOR(F.col(c + y))) <= nx + ny - 2 * need
    passed = (F.least(nx, ny) >= F.lit(threshold) * F.greatest(nx, ny) - 1e-9) & (F.least(nx - px, ny - py) >= need) & differ("low")
    return passed & F.when(both, whole("second") & whole("wide_b")).when(none, whole("low") & differ("second")).otherwise(F.lit(True))


def prefix_size(n: Column, threshold: float) -> Column:
    return (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int")


STORED = ("low", "wide_a", "wide_b", "prefix")
SUMMARIES = ("low", "second", "wide_b")  # second: of the prefix, or of all tokens if there are over ``WINDOW``
POSTING = ("n", "pos", *SUMMARIES, "doc_id", "line_no", "cid")


def level(token: Column) -> Column:
    return F.shiftrightunsigned(token, 58).cast("int")


def postings(classes: DataFrame, threshold: float) -> DataFrame:
    """token and POSTING: a row for each prefix token. Equal sets are one class, so sets that match only when equal have
    none; a token in a slot that has met no other one is in no other line."""
    some = classes.where(pairs_up(F.col("n"), threshold)).withColumn("second", F.when(F.col("n") <= WINDOW, summary("prefix", 6)).otherwise(F.col("wide_a")))
    return some.select(F.posexplode("prefix").alias("pos", "token"), *[c for c in POSTING if c != "pos"]).where(level(F.col("token")) != 0)


def led(held: DataFrame, salt: Column) -> DataFrame:
    """Postings beside their bucket's earliest one (_y), itself aside. Its columns are taken one by one: a struct of them
    would be made of every posting and shuffled with it."""
    before = Window.partitionBy("token", salt).orderBy("doc_id", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    return held.select("*", *[F.first(c).over(before).alias(f"{c}_y") for c in POSTING]).where("cid <> cid_y")


def removed_lines(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line_no (from 0) of every line that an earlier one is equal or similar to.

    Rows without text or id have no lines here, lines without a token are left alone. Rows that repeat an id share their
    decisions, line by line. A text of any length is cut into its lines; a line is one set however long. Other columns
    are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    lines = split_lines(docs)
    levels, hot = rarity(lines)
    n = F.size("tokens")
    compact = token_sets(lines, levels).select("doc_id", "line_no", n.alias("n"), *keys(), summary("tokens", 0).alias("low"), wide_summary(12).alias("wide_a"), wide_summary(18).alias("wide_b"), F.slice("tokens", 1, prefix_size(n, threshold)).alias("prefix"))
    compact = written(compact, "line_sets")
    first = F.min(F.struct("doc_id", "line_no")).alias("first")
    classes = compact.groupBy("k1", "k2").agg(first, *[F.any_value(c).alias(c) for c in ("n", *STORED)])
    classes = written(classes.select("k1", "k2", "first.*", "n", *STORED, F.monotonically_increasing_id().alias("cid")), "line_classes")

    held = postings(classes, threshold)
    parts = F.call_function("shiftleft", F.lit(1), F.greatest(level(F.col("token")) - hot + 1, F.lit(0)))  # tasks for a token's bucket
    salt = F.pmod(F.xxhash64("cid"), parts).cast("int")
    near = led(held, salt).where(passes("", "_y", threshold))
    settled = _similar(near, docs, classes, levels, threshold)

    as_y = lambda df, *more: df.select("token", *[F.col(c).alias(f"{c}_y") for c in POSTING], *more)
    earlier = (F.col("doc_id_y") < F.col("doc_id")) | ((F.col("doc_id_y") == F.col("doc_id")) & (F.col("line_no_y") < F.col("line_no")))
    cold = held.where(level(F.col("token")) < hot).repartition("token")  # one shuffle serves both sides
    # an outer join stays above that shuffle, where an anti join would be pushed below it
    left = cold.join(settled.withColumn("late", F.lit(True)), "cid", "left").where("late is null")
    near = left.join(as_y(cold), "token").where(earlier & passes("", "_y", threshold)).select("cid", "cid_y")
    if hot < 32:
        warm = postings(classes.where(level(F.element_at("prefix", -1)) >= hot), threshold).where(level(F.col("token")) >= hot)
        every = warm.join(settled, "cid", "left_anti").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        near = near.unionByName(every.join(as_y(warm, salt.alias("salt")), ["token", "salt"]).where(earlier & passes("", "_y", threshold)).select("cid", "cid_y"))
    late = settled.unionByName(_similar(near, docs, classes, levels, threshold)).withColumn("late", F.lit(True))

    judged = classes.select("k1", "k2", "cid", F.struct("doc_id", "line_no").alias("first")).join(late, "cid", "left").select("k1", "k2", "first", "late")
    out = compact.select("doc_id", "line_no", "k1", "k2").join(judged, ["k1", "k2"])
    return out.where(F.col("late") | (F.struct("doc_id", "line_no") != F.col("first"))).select("doc_id", "line_no").distinct()


def _similar(near: DataFrame, docs: DataFrame, classes: DataFrame, levels: Column, threshold: float) -> DataFrame:
    """cid of the classes that have a pair (cid, cid_y) in ``near`` whose whole sets are similar enough."""
    pairs = written(near.select("cid", F.col("cid_y").alias("early")).distinct(), "line_pairs")
    ends = pairs.select("cid").union(pairs.select("early")).distinct()
    wanted = written(classes.join(ends, "cid", "left_semi").select("cid", "k1", "k2", "doc_id", "line_no"), "line_wanted")
    at = wanted.groupBy("doc_id").agg(F.collect_set("line_no").alias("numbers"))  # at most a document's lines
    at = at.withColumnRenamed("doc_id", "id")
    at = F.broadcast(at) if wanted.select("doc_id").distinct().count() <= BROADCAST_ROWS else at
    some = docs.where("text is not null").join(at, F.col("doc_id").cast("long") == F.col("id")).select(F.split(F.col("text").cast("string"), "\n").alias("lines"), "numbers")
    some = some.select(F.explode(F.transform("numbers", lambda i: F.get("lines", i))).alias("line")).where("line is not null")
    full = token_sets(some, levels).select("tokens", *keys())
    full = written(full.join(wanted.select("cid", "k1", "k2"), ["k1", "k2"]).select("cid", "tokens").dropDuplicates(["cid"]), "line_tokens")
    x = full.select("cid", F.col("tokens").alias("tx"))
    y = full.select(F.col("cid").alias("early"), F.col("tokens").alias("ty"))
    enough = F.size(F.array_intersect("tx", "ty")) >= least_overlap(F.size("tx"), F.size("ty"), threshold)
    late = written(pairs.join(x, "cid").join(y, "early").where(enough).select("cid").distinct(), "line_late")
    for done in (pairs, wanted, full):
        discard(done)
    return late


def removed_by_document(docs: DataFrame, **options) -> DataFrame:
    removed = removed_lines(docs, **options)
    return removed.groupBy("doc_id").agg(F.sort_array(F.collect_list("line_no")).alias("removed"))  # at most a document's lines


def deduplicate_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all columns, whatever their names, and all rows, texts without their removed lines. A text may
    become empty; null stays null, and rows without an id keep their text."""
    removed = removed_by_document(docs, **options)
    lines = F.split("text", "\n")
    # a line's number is its place, so the kept ones are picked by position
    kept = F.filter(lines, lambda x, i: ~F.array_contains("found.removed", i))
    rows = docs.select(F.struct(*named(docs)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    joined = rows.join(removed.select(F.col("doc_id").alias("id"), F.struct("removed").alias("found")), "id", "left")
    text = F.when(F.col("found").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).cast(docs.schema["text"].dataType)
    return joined.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the removed lines' numbers of every document."""
    docs = table(spark, sf_dir, "documents")
    removed = removed_by_document(docs).withColumnRenamed("doc_id", "id")
    count = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    counted = docs.select("doc_id", count.alias("n_lines"))
    none = F.array().cast("array<int>")
    return counted.join(removed, F.col("doc_id") == F.col("id"), "left").select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce("removed", none).alias("removed"))

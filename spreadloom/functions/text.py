"""Text expressions: deadlines in questions, stems without dates and thresholds, tokens."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months, the phrases that deadlines, dates and thresholds are written with, and stop words.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
FULL_DATE = r"(?i)\b(?:by|before|in|on|at)\s+([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})"
DAY_DATE = r"(?i)\b(?:by|before|on|at)\s+([A-Za-z]+)\s+(\d{1,2})\b(?!\s*,?\s*\d{4})"
IN_YEAR = r"(?i)\b(?:in|on)\s+(\d{4})\b"
BEFORE_YEAR = r"(?i)\bbefore\s+(\d{4})\b"
DATE_LEADS = ["by end of", "by", "in", "on", "before", "after", "as of", "end of", "through", "until", "til"]
COMPARISONS = ["greater than", "at least", "more than", "less than", "fewer than", "above", "below", "under", "over", "exceeds", "reaches", "≥", "≤", ">=", "<="]
MAGNITUDES = ["trillion", "billion", "million", "thousand"]
STOP_WORDS = ["will", "the", "a", "an", "of", "by", "to", "in", "be", "is", "at", "on", "for", "and", "or", "any", "have", "has", "its", "their"]
EDGES = " ?.,-"  # cut from the ends of a stem
TOKEN_EDGES = ".,?'\"()\u2018\u2019\u201c\u201d-"  # cut from the ends of a token


def month_number(name: Column) -> Column:
    """1 to 12 for a month's name or its first three letters, else null."""
    place = lambda names: F.nullif(F.array_position(F.array(*map(F.lit, names)), F.lower(name)), F.lit(0).cast("long"))
    return F.coalesce(place(MONTHS), place([m[:3] for m in MONTHS])).cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def deadline(question: Column, as_of: Column) -> Column:
    """A full date; else a day's next occurrence from ``as_of``; else the year's end; else the end of the year before.
    A day that the year it falls in doesn't have counts for nothing."""
    full = _date(_group(question, FULL_DATE, 3), month_number(_group(question, FULL_DATE, 1)), _group(question, FULL_DATE, 2))
    month, day = month_number(_group(question, DAY_DATE, 1)), _group(question, DAY_DATE, 2)
    this, following = _date(F.year(as_of), month, day), _date(F.year(as_of) + 1, month, day)
    year, before = _group(question, IN_YEAR, 1).cast("int"), _group(question, BEFORE_YEAR, 1).cast("int")
    return F.coalesce(full, F.when(this >= as_of, this).when(this < as_of, following), F.make_date(year, F.lit(12), F.lit(31)), F.make_date(before - 1, F.lit(12), F.lit(31)))


def _lexemes(text: Column, pattern: str) -> Column:
    """Lower-case pieces of a text as (gap: white space stands before it, t)."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"\s*(?:{pattern}|[^\sa-z0-9])"), F.lit(0))
    return F.transform(found, lambda x: F.struct((F.trim(x) != x).alias("gap"), F.regexp_replace(x, r"^\s+", "").alias("t")))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _numeral(c: Column) -> Column:
    return F.translate(c, "0123456789", "") == ""


def _without(pieces: Column, run: Column, longest: int) -> Column:
    """The pieces that no run covers; ``run`` has the number of pieces that go from each one on. What follows a run has a
    gap before it."""
    offsets = F.array(*map(F.lit, range(longest)))
    gone = lambda i: F.exists(offsets, lambda j: _yes(F.get(run, i - j) > j))
    kept = F.transform(pieces, lambda x, i: F.struct((x["gap"] | gone(i - 1)).alias("gap"), F.when(~gone(i), x["t"]).alias("t")))
    return F.filter(kept, lambda x: x["t"].isNotNull())


def _written(pieces: Column) -> Column:
    """Pieces put together again with single blanks in gaps and none at the ends."""
    return F.trim(F.array_join(F.transform(pieces, lambda x: F.when(x["gap"], F.concat(F.lit(" "), x["t"])).otherwise(x["t"])), ""))


LEADS = sorted((p.split(" ") for p in DATE_LEADS), key=len, reverse=True)


def _lead(words: Callable[[int, int], Column]) -> Column:
    """The length of the preposition whose words stand at ``words(length, place)``, 0 if there is none."""
    found = F.when(F.lit(False), 0)
    for phrase in LEADS:
        found = found.when(_yes(reduce(lambda a, b: a & b, [words(len(phrase), k) == w for k, w in enumerate(phrase)])), len(phrase))
    return found.otherwise(0)


def strip_dates(question: Column) -> Column:
    """Lower-case stem without dates, prepositions before them or at the end, and punctuation at the ends.

    A date is a month and a day, with or without a year, a month and a year, a quarter of a year, numbers with strokes,
    or a year alone, all years of this century; a month alone only counts after a preposition. A month is a word that
    begins like one. A year stays where it is part of a number, an amount, a longer word or an identifier like clerk#2059.
    """
    months = F.array(*[F.lit(m[:3]) for m in MONTHS])

    def month(t: Column) -> Column:
        return _yes(F.array_contains(months, F.left(t, F.lit(3))))

    def year(t: Column) -> Column:
        return _yes(t.between("2000", "2099") & (F.length(t) == 4) & _numeral(t))

    def few(t: Column, least: int, most: int) -> Column:
        return _yes(F.length(t).between(least, most) & _numeral(t))

    def date(p: Column, i: Column) -> Column:
        """The number of pieces of the date that begins at ``i``."""
        t = lambda k: F.get(p, i + k)["t"]
        apart = lambda k: _yes(F.get(p, i + k)["gap"])
        day = few(F.regexp_replace(t(1), "(st|nd|rd|th)$", ""), 1, 2) & apart(1)
        with_year = F.when(year(t(2)), 3).when(_yes(t(2) == ",") & year(t(3)), 4).otherwise(2)
        stroke = lambda k: _yes(t(k) == "/") & ~apart(k) & ~apart(k + 1)
        quarter = _yes((t(0) == "q") & t(1).isin("1", "2", "3", "4")) & ~apart(1) & year(t(2))
        found = F.when(month(t(0)), F.when(day, with_year).when(year(t(1)) & apart(1), 2).otherwise(0)).when(quarter, 3).when(year(t(0)), 1)
        return found.when(few(t(0), 1, 2) & stroke(1) & few(t(2), 1, 2), F.when(stroke(3) & few(t(4), 2, 4), 5).otherwise(3)).otherwise(0)

    def run(p: Column, dates: Column, i: Column) -> Column:
        """The number of pieces that go from ``i`` on: a preposition and its date or month, or a date."""
        at = lambda k: F.get(p, i + k)
        lead = _lead(lambda n, k: at(k)["t"])
        led = lambda n: F.when(F.get(dates, i + n) > 0, n + F.get(dates, i + n)).when(month(at(n)["t"]), n + 1)
        size = F.get(dates, i)
        after, before = F.get(p, (i + size).cast("int")), at(-1)["t"]
        part = ~at(0)["gap"] & year(at(0)["t"]) & _yes(before.isin("$", ",", ".", "#") | before.rlike("[a-z0-9]$"))
        goes_on = _yes(~after["gap"] & after["t"].rlike("^[a-z0-9]"))
        bare = F.when((size > 0) & ~part & ~goes_on, size).otherwise(0)
        return F.when(lead > 0, F.coalesce(F.element_at(F.array(*map(led, (1, 2, 3))), lead), F.lit(0))).otherwise(bare)

    def stem(p: Column) -> Column:
        dates = F.transform(p, lambda x, i: date(p, i))
        kept = _let(dates, lambda d: _let(F.transform(p, lambda x, i: run(p, d, i)), lambda r: _without(p, r, 8)))
        return _let(kept, lambda x: _written(F.slice(x, 1, F.size(x) - _lead(lambda n, k: F.get(x, F.size(x) - n + k)["t"]))))

    return F.btrim(_let(_lexemes(question, r"[a-z]+\.?|[0-9]+(?:st|nd|rd|th)?"), stem), F.lit(EDGES))


def strip_thresholds(text: Column) -> Column:
    """Lower-case text without amounts of money, percentages, numbers of a magnitude and comparisons, nor punctuation at
    the ends. Comparisons go wherever they stand, inside words too."""

    def run(p: Column, i: Column) -> Column:
        t = lambda k: F.get(p, i + k)["t"]
        number = lambda k: _yes(F.left(t(k), F.lit(1)).between("0", "9"))
        money = F.when(_yes(t(2).isin("t", "b", "m", "k")), 3).otherwise(2)
        counted = _yes(t(1) == "%") | _yes(t(1).isin(MAGNITUDES)) & ~_yes(t(-1) == "$")
        return F.when(_yes(t(0) == "$") & number(1), money).when(number(0) & counted, 2).otherwise(0)

    def plain(p: Column) -> Column:
        return _let(F.transform(p, lambda x, i: run(p, i)), lambda r: _written(_without(p, r, 3)))

    held = _let(_lexemes(text, r"[a-z]+|[0-9][0-9,]*(?:\.[0-9]+)?"), plain)
    held = F.aggregate(F.array(*map(F.lit, COMPARISONS)), held, lambda x, phrase: F.replace(x, phrase, F.lit(" ")))
    return F.btrim(F.regexp_replace(held, r"\s+", " "), F.lit(EDGES))


def norm_tokens(text: Column) -> Column:
    """Distinct lower-case tokens outside parentheses, cut at their ends, that are neither stop words nor plain numbers."""
    closed = lambda x: F.contains(x, F.lit(")"))
    parts = F.transform(F.split(F.lower(text), r"\("), lambda x, i: F.when(i == 0, x).when(closed(x), F.concat(F.lit(" "), F.substr(x, F.instr(x, ")") + 1))).otherwise(F.concat(F.lit("("), x)))
    inner = rf"[^\s{TOKEN_EDGES}]"  # a token begins and ends with what is no edge
    tokens = F.transform(F.regexp_extract_all(F.array_join(parts, ""), F.lit(rf"{inner}(?:\S*{inner})?"), F.lit(0)), lambda x: F.translate(x, "\u2018\u2019\u201c\u201d", "''\"\""))
    number = lambda x: F.left(x, F.lit(1)).between("0", "9") & (F.translate(x, "0123456789.,", "") == "")
    return F.array_distinct(F.filter(tokens, lambda x: ~x.isin(STOP_WORDS) & ~number(x)))


def terms(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Lower-case words of two or more ASCII letters or digits, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]{2,}"), F.lit(0)), lambda t: ~t.isin(stop))

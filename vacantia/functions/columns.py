"""Small column expressions that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def now(as_of: str) -> Column:
    """The explicit moment that operators use for the current time."""
    return F.lit(as_of).cast("timestamp_ntz")


def ago(as_of: str, days: float = 0, hours: int = 0) -> Column:
    return now(as_of) - F.expr(f"INTERVAL {int(days)} DAYS") - F.expr(f"INTERVAL {int(hours)} HOURS")


def micros(moment: Column) -> Column:
    """Microseconds of a moment without a time zone since 1970."""
    return F.unix_micros(F.to_utc_timestamp(moment.cast("timestamp"), F.current_timezone()))


def seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two moments without a time zone, as a double."""
    return (micros(later) - micros(earlier)) / 1e6


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def percentage(part: Column, whole: Column, digits: int = 2) -> Column:
    """part / whole in percent, rounded half away from zero; NULL where whole is 0."""
    return F.round(part.cast("double") / F.nullif(whole, F.lit(0)).cast("double") * 100, digits)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def every(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def contains_text(column: str, needle: str) -> Column:
    """Case-insensitive containment; % and _ in the needle are wildcards, as in the search they serve."""
    return F.col(column).ilike(f"%{needle}%")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text's words, each padded with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_distance(a: Column, b: Column) -> Column:
    """1 - shared / all distinct trigrams of two texts (0 same, 1 nothing in common). An array of one
    holds both texts' trigrams, so that they are made once."""
    both = F.array(F.struct(trigrams(a).alias("x"), trigrams(b).alias("y")))
    distance = lambda p: 1 - F.size(F.array_intersect(p["x"], p["y"])) / F.nullif(F.size(F.array_union(p["x"], p["y"])), F.lit(0))
    return F.get(F.transform(both, distance), 0)

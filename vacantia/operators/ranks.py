"""Exact percentiles of groups of any size, by selecting ranks over histograms.

`percentile_cont` keeps a group's values in one buffer, which a hot group outgrows. Here the values around
the wanted ranks are narrowed down instead: each pass counts a group's values in bins between the least
and largest value that are still in question, and keeps the bin of each wanted rank; the last pass counts
equal values within that bin. Counts are summed before they are shuffled, so no group's values meet.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values of a group that one buffer may hold.
DIRECT = 1_000_000
#: Bins of a pass, and passes before equal values are counted: values in question fall to n / BINS**PASSES, about.
BINS, PASSES = 4096, 2


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"__{k}"]) for k in keys], F.lit(True))


def _renamed(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    return frame.withColumnsRenamed({k: f"__{k}" for k in keys})


def _counted(rows: DataFrame, targets: DataFrame, keys: Sequence[str], bin_: Column, *kept: Column) -> DataFrame:
    """Of each range in question its bins with their counts and how many of the range's values come before."""
    ranges = _renamed(targets.select(*keys, "lo", "hi").distinct(), keys)
    inside = rows.join(ranges, _same(rows, ranges, keys)).filter(F.col("v").between(F.col("lo"), F.col("hi")))
    bins = inside.groupBy(*keys, "lo", "hi", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
    before = W.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    return bins.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))


def _narrowed(targets: DataFrame, bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each wanted rank with the bin that holds it as its new range."""
    named = _renamed(bins, [*keys, "lo", "hi"])
    both = targets.join(named, _same(targets, named, [*keys, "lo", "hi"]))
    within = F.col("rank") - F.col("base")
    held = both.filter((within >= F.col("before")) & (within < F.col("before") + F.col("c")))
    return held.select(*keys, "rank", "share", "at", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("base") + F.col("before")).alias("base"))


def exact_percentile(rows: DataFrame, keys: Sequence[str], value: str, fraction: float = 0.5, bins: int = BINS, passes: int = PASSES) -> DataFrame:
    """(keys, percentile): the continuous percentile of each group's values, NULLs left out; groups without a
    value have no row. Equal to percentile_cont for finite doubles; NULL keys are a group."""
    rows = rows.select(*keys, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = fraction * (F.col("n") - 1)
    low = F.floor(place)
    ranks = F.array(F.struct(low.alias("rank"), (1 - (place - low)).alias("share"), F.lit(0).alias("at")), F.struct(F.ceil(place).alias("rank"), (place - low).alias("share"), F.lit(1).alias("at")))
    targets = stats.select(*keys, "lo", "hi", F.inline(ranks)).filter((F.col("at") == 0) | (F.col("share") > 0)).withColumn("base", F.lit(0).cast("long"))
    width = F.col("hi") - F.col("lo")
    for _ in range(passes):
        bin_ = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")
        targets = _narrowed(targets, _counted(rows, targets, keys, bin_), keys)
    found = _narrowed(targets, _counted(rows, targets, keys, F.col("v")), keys)
    # As the two neighbours are weighed in one sum, it is made in their order.
    pair = F.array_sort(F.collect_list(F.struct("at", "share", "lo")))
    weighed = F.aggregate(pair, F.lit(0.0), lambda a, p: a + p["share"] * p["lo"])
    return found.groupBy(*keys).agg(weighed.alias("percentile"))


def with_percentile(rows: DataFrame, keys: Sequence[str], figures: Sequence[Column], value: str, name: str, fraction: float = 0.5, direct: int = DIRECT) -> DataFrame:
    """rows.groupBy(keys).agg(figures) with a percentile of a column under `name`: in the same aggregation where
    every group's values fit a buffer (a first count says so), else by selecting ranks."""
    held = rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > direct)
    if not held.limit(1).count():
        return rows.groupBy(*keys).agg(*figures, F.expr(f"percentile_cont({fraction}) WITHIN GROUP (ORDER BY {value})").alias(name))
    base, found = rows.groupBy(*keys).agg(*figures), _renamed(exact_percentile(rows, keys, value, fraction), keys)
    return base.join(found, _same(base, found, keys), "left").withColumnRenamed("percentile", name).drop(*[f"__{k}" for k in keys])

"""Market statistics: daily figures, segments, region labels, series, and the tables they are kept in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantia.functions.columns import count_where, now, seconds
from vacantia.operators import ranks

FULLY_REMOTE = ("remote_only", "remote_region_locked")
EU_CLASSES = ("eu_member_state", "eu_explicit", "eu_region")
#: Scopes outside the market; salaries below the floor count for no segment; score of an approved offer.
EXCLUDED_SCOPES = "americ|apac|latam|asia pacific"
SALARY_FLOOR, FEED_SCORE = 10_000, 80


def _within(column: str, day: str) -> Column:
    return (F.col(column) >= now(day)) & (F.col(column) < now(day) + F.expr("INTERVAL 1 DAY"))


def _active() -> Column:
    return F.coalesce(F.col("availability_status") == "active", F.lit(False))


def daily_stats(jobs: DataFrame, job_sources: DataFrame, day: str, direct: int = ranks.DIRECT) -> DataFrame:
    """One row for the day [00:00, 24:00) UTC, from one pass over jobs and one over their sources (and more for
    the median, where more salaries than `direct` are active)."""
    remote = F.when(F.col("remote_class").isin(*FULLY_REMOTE), 1.0).otherwise(0.0)
    salary = F.when(_active(), F.col("salary_min_eur"))
    figures = [
        count_where(_within("first_seen_at", day)).alias("jobs_created"),
        count_where((F.col("availability_status") == "expired") & _within("last_seen_at", day)).alias("jobs_expired"),
        count_where(_active()).alias("jobs_active"),
        count_where(F.col("is_repost") & _within("first_seen_at", day)).alias("jobs_reposted"),
        F.avg(salary).alias("avg_salary_eur"),
        F.avg(F.when(_active(), remote)).alias("remote_ratio"),
    ]
    market = ranks.with_percentile(jobs.withColumn("__active_salary", salary), [], figures, "__active_salary", "median_salary_eur", direct=direct)
    life = job_sources.filter(_within("last_seen_at", day)).agg(F.avg(seconds(F.col("last_seen_at"), F.col("first_seen_at"))).alias("avg_job_lifetime_s"))
    return market.crossJoin(life).select(F.lit(day).cast("date").alias("date"), "*")  # two rows of one


def _segments(offers: DataFrame, kind: str, value: Column, day: str, direct: int = ranks.DIRECT) -> DataFrame:
    paid = F.when(F.col("salary_min_eur") >= SALARY_FLOOR, F.col("salary_min_eur"))
    figures = [count_where(_active()).alias("jobs_active"), count_where(_within("first_seen_at", day)).alias("jobs_created"), F.count("paid").alias("salary_count"), F.avg("paid").alias("avg_salary_eur")]
    out = ranks.with_percentile(offers.withColumns({"segment_value": value, "paid": paid}), ["segment_value"], figures, "paid", "median_salary_eur", direct=direct)
    return out.select(F.lit(day).cast("date").alias("date"), F.lit(kind).alias("segment_type"), "*")


def _offers(jobs: DataFrame, day: str) -> DataFrame:
    live = _active() | _within("first_seen_at", day)
    return jobs.filter((F.col("compliance_status") == "approved") & (F.col("compliance_score") >= FEED_SCORE) & live)


def country_segments(jobs: DataFrame, day: str, direct: int = ranks.DIRECT) -> DataFrame:
    """Approved offers by remote scope (EU) or as `Non EU`."""
    value = F.when(F.col("geo_class").isin(*EU_CLASSES), F.coalesce("remote_scope", "geo_class")).otherwise("Non EU")
    return _segments(_offers(jobs, day).filter(F.col("geo_class").isNotNull()), "country", value, day, direct)


def column_segments(jobs: DataFrame, day: str, columns=("job_family", "seniority"), direct: int = ranks.DIRECT) -> DataFrame:
    parts = [_segments(_offers(jobs, day).filter(F.col(c).isNotNull()), c, F.col(c), day, direct) for c in columns]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def region_label(value: Column) -> Column:
    """One spelling for home-based and remote-job labels."""
    value = F.regexp_replace(value, r"(?i)^home\s+based\s*[-–]\s*", "Remote - ")
    return F.regexp_replace(value, r"(?i)^remote\s+job\s*[,\s]+\s*", "Remote - ")


def canonical_region(label: Column) -> Column:
    for pattern in (r"(?i)^republic\s+of\s+", r"(?i)^remote\s*[-–]\s*", r"(?i)\s*\(remote\)\s*$"):
        label = F.regexp_replace(label, pattern, "")
    return F.trim(label)


def label_priority(label: Column) -> Column:
    """`Remote - X` before `X (Remote)` before plain `X`."""
    return F.when(label.rlike(r"(?i)^remote\s*[-–]"), 0).when(F.lower(label).endswith(" (remote)"), 1).otherwise(2)


def normalised_regions(segments: DataFrame) -> DataFrame:
    """Country rows with their labels rewritten, without foreign scopes, and of each region only those
    with its best label. Among labels of one priority the first in order is best. Labels are few."""
    kept = segments.filter(~F.lower(F.coalesce("segment_value", F.lit(""))).rlike(EXCLUDED_SCOPES)).withColumn("segment_value", region_label(F.coalesce("segment_value", F.lit(""))))
    labels = kept.select("segment_value").distinct().withColumn("region", canonical_region(F.col("segment_value"))).filter(F.col("region") != "")
    best = W.partitionBy("region").orderBy(label_priority(F.col("segment_value")), "segment_value")
    winners = labels.withColumn("n", F.row_number().over(best)).filter("n = 1").select("segment_value")
    return kept.join(winners, "segment_value", "left_semi")


def keep_first(table: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Insert or do nothing: rows whose key the table has are not taken, and of several new rows with one
    key the least, column by column."""
    least = new.groupBy(*keys).agg(F.min(F.struct(F.lit(1).alias("__one"), *[c for c in new.columns if c not in keys])).alias("__row"))
    one = least.select(*(c if c in keys else F.col(f"__row.{c}").alias(c) for c in new.columns))
    return table.unionByName(one.join(table.select(*keys).distinct(), list(keys), "left_anti"))


def replace_by_key(table: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Insert or update: rows whose key is new's give way."""
    return table.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def latest_snapshot(segments: DataFrame) -> DataFrame:
    last = segments.agg(F.max("date").alias("date"))
    return segments.join(F.broadcast(last), "date").drop("date").orderBy("segment_type", F.desc("jobs_active"), "segment_value")


def breakdown(segments: DataFrame, kind: str, most: int = 8) -> DataFrame:
    """The panel's rows: the 7 largest regions and `Non EU` at the end, or the 8 largest of another
    kind; bar length, and the median salary where there are enough salaries to trust it."""
    rows = segments.filter(F.col("segment_type") == kind)
    last = (F.col("segment_value") == "Non EU") if kind == "country" else F.lit(False)
    rank = F.row_number().over(W.partitionBy("apart").orderBy(F.desc("jobs_active"), "segment_value"))
    shown = rows.withColumn("apart", last).withColumn("rank", rank).filter(F.col("apart") | (F.col("rank") <= (most - 1 if kind == "country" else most)))
    biggest = F.max("jobs_active").over(W.partitionBy())
    thousands = F.floor(F.col("median_salary_eur") / 1000 + 0.5).cast("long")
    trusted = (thousands >= 10) & (F.col("salary_count") >= 3) & (F.col("jobs_active") > 0) & (F.col("salary_count") >= 0.25 * F.col("jobs_active"))
    bar = F.when(biggest > 0, F.floor(F.col("jobs_active") / biggest * 100 + 0.5)).otherwise(0).cast("long")
    return shown.select("segment_value", "jobs_active", bar.alias("bar_pct"), F.when(trusted, thousands).alias("median_k"), F.col("rank").alias("place")).orderBy(F.col("segment_value") == "Non EU", "place")


def active_counts(jobs: DataFrame) -> DataFrame:
    return jobs.filter("availability_status = 'active'").agg(F.count(F.lit(1)).alias("jobs_total"), count_where(F.col("compliance_score") >= FEED_SCORE).alias("jobs_approved"))


def backfilled_ratio(stats: DataFrame, jobs: DataFrame) -> DataFrame:
    """Daily rows whose remote ratio is 0.0 get the current one."""
    current = jobs.filter("availability_status = 'active'").agg(F.avg(F.when(F.col("remote_class").isin(*FULLY_REMOTE), 1.0).otherwise(0.0)).alias("__now"))
    return stats.crossJoin(F.broadcast(current)).withColumn("remote_ratio", F.when(F.col("remote_ratio").eqNullSafe(0.0), F.col("__now")).otherwise(F.col("remote_ratio"))).drop("__now")


def period_metrics(stats: DataFrame, days: int) -> DataFrame:
    """Over the last days' rows: the latest active count, means of medians and of remote ratios."""
    recent = stats.orderBy(F.desc("date")).limit(days)
    return recent.agg(F.max_by("jobs_active", "date").alias("total_active"), F.avg("median_salary_eur").alias("median_salary"), F.avg("remote_ratio").alias("remote_ratio"))


def recent_days(stats: DataFrame, today: str, days: int) -> DataFrame:
    return stats.filter(F.col("date") >= F.date_sub(F.lit(today).cast("date"), days)).orderBy("date")


def interpolated(series: DataFrame, order: str, value: str, *keys: str) -> DataFrame:
    """Gaps filled on a line between their neighbours, by position; ends with the nearest value."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    numbered = series.withColumn("__i", place).withColumn("__at", F.when(F.col(value).isNotNull(), F.col("__i")))
    back = W.partitionBy(*keys).orderBy("__i").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*keys).orderBy("__i").rowsBetween(0, W.unboundedFollowing)
    ends = {"__i0": F.last("__at", True).over(back), "__v0": F.last(value, True).over(back), "__i1": F.first("__at", True).over(ahead), "__v1": F.first(value, True).over(ahead)}
    out = numbered.withColumns(ends)
    line = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * (F.col("__i") - F.col("__i0")) / F.nullif(F.col("__i1") - F.col("__i0"), F.lit(0))
    filled = F.coalesce(F.col(value), line, "__v0", "__v1")
    return out.withColumn(value, filled).drop("__i", "__at", *ends)


def filled_with_zero(series: DataFrame, value: str) -> DataFrame:
    """The other policy for gaps: they count as 0."""
    return series.withColumn(value, F.coalesce(F.col(value), F.lit(0).cast(series.schema[value].dataType)))


def axis_labels(series: DataFrame, day: str = "date", most: int = 6) -> DataFrame:
    """(place, label): evenly spaced days of a series, `most` at most, first and last among them."""
    place, n = F.row_number().over(W.orderBy(day)) - 1, F.count(F.lit(1)).over(W.partitionBy())  # a chart's days
    rows = series.select(day).distinct().select(day, place.alias("place"), n.alias("n"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("n") - 1) / (most - 1)).cast("int"))
    return rows.filter((F.col("n") <= most) | F.array_contains(spread, F.col("place"))).select("place", F.date_format(day, "MMM dd").alias("label"))


def scaled(series: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Values on [low, high]; a flat series lies in the middle."""
    least, most = F.min(value).over(W.partitionBy()), F.max(value).over(W.partitionBy())
    at = (F.col(value) - least) / F.nullif(most - least, F.lit(0.0))
    return series.withColumn("scaled", F.coalesce(low + (high - low) * at, F.when(F.col(value).isNotNull(), F.lit((low + high) / 2))))


def system_metrics(jobs: DataFrame, companies: DataFrame, company_ats: DataFrame, as_of: str) -> DataFrame:
    """Totals and additions of 24 hours, each table read once."""
    day = now(as_of) - F.expr("INTERVAL 24 HOURS")
    a = jobs.agg(F.count(F.lit(1)).alias("jobs_total"), count_where(F.col("first_seen_at") >= day).alias("jobs_24h"), F.max("last_seen_at").alias("last_tick_at"))
    b = companies.agg(F.count(F.lit(1)).alias("companies_total"))
    c = company_ats.agg(F.count(F.lit(1)).alias("company_ats_total"), count_where(F.col("created_at") >= day).alias("company_ats_24h"))
    return a.crossJoin(b).crossJoin(c)  # rows of one

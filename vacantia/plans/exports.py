"""Exports: the feed and the market files as one JSON document each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.operators import audit, search
from vacantia.operators.market import latest_snapshot, normalised_regions, system_metrics

FEED_LIMIT, FEED_SCORE = 200, 80
_FEED = {"id": "job_id", "title": "title", "company": "company_name", "remote_scope": "remote_scope", "source": "source", "first_seen_at": "first_seen_at", "status": "status", "last_seen_at": "last_seen_at", "job_family": "job_family", "salary_min_eur": "salary_min_eur", "salary_max_eur": "salary_max_eur"}


def feed_jobs(jobs: DataFrame) -> DataFrame:
    """The visible, well-scored jobs of the feed, newest first."""
    return search.page(search.search(jobs, status="visible", min_compliance_score=FEED_SCORE), FEED_LIMIT)


def feed_meta(feed: DataFrame) -> DataFrame:
    """Count, salaries' range and postings per family, of at most FEED_LIMIT rows."""
    paid = F.nullif("salary_min_eur", F.lit(0.0))
    return feed.agg(F.count(F.lit(1)).alias("count"), F.min(paid).alias("salary_min"), F.max(paid).alias("salary_max"))


def feed_departments(feed: DataFrame) -> DataFrame:
    known = feed.filter(F.col("job_family").isNotNull() & (F.col("job_family") != "unknown"))
    return known.groupBy(F.col("job_family").alias("name")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "name")


def feed_json(jobs: DataFrame) -> DataFrame:
    """feed.json as one row: items leave out their NULL fields."""
    feed = feed_jobs(jobs)
    items = feed.agg(F.sort_array(F.collect_list(F.struct(F.col("first_seen_at").alias("at"), F.struct(*[F.col(c).alias(n) for n, c in _FEED.items()]).alias("job"))), asc=False).alias("rows"))
    departments = feed_departments(feed).agg(F.collect_list(F.struct("name", "count")).alias("departments"))
    meta = feed_meta(feed).crossJoin(departments).crossJoin(items)  # rows of one
    document = F.struct(F.struct("count", F.lit("visible").alias("status"), F.lit(FEED_LIMIT).alias("limit"), "departments", F.struct(F.col("salary_min").alias("min"), F.col("salary_max").alias("max")).alias("salary_range_eur")).alias("meta"), F.transform("rows", lambda r: r["job"]).alias("jobs"))
    return meta.select(F.to_json(document).alias("document"))


def segments_json(segments: DataFrame) -> DataFrame:
    """market-segments.json as one row: the latest day's segments by type."""
    last = latest_snapshot(segments)
    rows = normalised_regions(last.filter("segment_type = 'country'")).unionByName(last.filter("segment_type <> 'country'"))
    item = F.struct(F.col("segment_value").alias("value"), "jobs_active", "jobs_created", "salary_count", "avg_salary_eur", "median_salary_eur")
    by_type = rows.groupBy("segment_type").agg(F.sort_array(F.collect_list(F.struct((-F.col("jobs_active")).alias("order"), item.alias("item")))).alias("items"))
    types = by_type.select("segment_type", F.transform("items", lambda i: i["item"]).alias("items"))
    table = types.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("segment_type", "items")))).alias("segments"))
    return table.select(F.to_json(F.struct("segments")).alias("document"))


def audit_parts(jobs: DataFrame, job_sources: DataFrame, companies: DataFrame, company_ats: DataFrame, reports: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """The six tables of the audit snapshot. Each has a row for a source, a company, a board or a week."""
    return {
        "metrics": system_metrics(jobs, companies, company_ats, as_of),
        "ats_health": audit.failing_integrations(company_ats, companies, as_of, 3),
        "source_trend": audit.source_trend(jobs, job_sources, as_of, 30),
        "rejection_reasons": audit.rejection_reasons(jobs, job_sources, reports, as_of, 30),
        "company_stats": audit.company_stats(jobs, companies, 5),
        "source_7d": audit.source_stats(jobs, job_sources, as_of),
    }


def part_sizes(parts: dict[str, DataFrame]) -> DataFrame:
    sizes = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    out = sizes[0]
    for size in sizes[1:]:
        out = out.union(size)
    return out


def audit_json(parts: dict[str, DataFrame], as_of: str) -> DataFrame:
    """audit_snapshot.json as one row."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
        out = one if out is None else out.crossJoin(one)  # rows of one
    return out.select(F.to_json(F.struct(F.lit(as_of).alias("generated_at"), *parts)).alias("document"))


def stats_json(stats: DataFrame, counts: DataFrame) -> DataFrame:
    """market-stats.json as one row: a month's days in order, and the active counts."""
    days = stats.agg(F.sort_array(F.collect_list(F.struct("date", *[c for c in stats.columns if c != "date"]))).alias("stats"))
    return days.crossJoin(counts).select(F.to_json(F.struct(F.struct("jobs_total", "jobs_approved").alias("meta"), "stats")).alias("document"))

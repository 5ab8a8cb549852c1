"""The exported JSON documents read back as rows, against the queries that they are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.operators import market
from vacantia.plans import exports
from vacantia.plans.audit_queries import HEALTH, REASONS, SOURCE_STATS, SOURCE_TREND
from vacantia.plans.bindings import AS_OF
from vacantia.plans.discovery_queries import FEED
from vacantia.plans.market_queries import COLUMNS, DAYS, PAID, REGIONS, SERIES, SYSTEM, segments, series
from vacantia.plans.registry import query


def listed(document: DataFrame, path: str, row: T.StructType | str) -> DataFrame:
    """The rows of a list in a document of one row: path is its name, behind the names of objects around it."""
    kind = row.simpleString() if isinstance(row, T.StructType) else row
    schema = f"array<{kind}>"
    for name in reversed(path.split(".")):
        schema = f"struct<`{name}`:{schema}>"
    return document.select(F.inline(_at(F.from_json("document", schema), path)))


def _at(column, path: str):
    for name in path.split("."):
        column = column[name]
    return column


def snapshot(t):
    parts = exports.audit_parts(t.jobs, t.job_sources, t.companies, t.company_ats, t.compliance_reports, AS_OF)
    return parts, exports.audit_json(parts, AS_OF)


for _part, _sql, _views in (("source_7d", SOURCE_STATS, ()), ("rejection_reasons", REASONS.format(30), ()), ("ats_health", HEALTH.format(""), ()), ("source_trend", SOURCE_TREND, ()), ("metrics", SYSTEM, ("jobs_v", "companies_v", "company_ats_v"))):
    query(f"k15_snapshot_{_part}", _sql, *_views)(lambda t, p=_part: (lambda parts, document: listed(document, p, parts[p].schema))(*snapshot(t)))

query("k11_feed_rows", f"SELECT job_id AS id, title, company_name AS company, remote_scope, source, first_seen_at, status, last_seen_at, job_family, salary_min_eur, salary_max_eur FROM ({FEED})", "jobs_v")(
    lambda t: listed(exports.feed_json(t.jobs), "jobs", "struct<id:string,title:string,company:string,remote_scope:string,source:string,first_seen_at:timestamp_ntz,status:string,last_seen_at:timestamp_ntz,job_family:string,salary_min_eur:double,salary_max_eur:double>")
)
query("k12_stats_rows", SERIES, rounded=DAYS)(lambda t: listed(exports.stats_json(series(t), market.active_counts(t.jobs)), "stats", series(t).schema))


def segment_rows(t):
    item = "value:string,jobs_active:bigint,jobs_created:bigint,salary_count:bigint,avg_salary_eur:double,median_salary_eur:double"
    types = exports.segments_json(segments(t)).select(F.explode(F.from_json("document", f"struct<segments:map<string,array<struct<{item}>>>>")["segments"]).alias("segment_type", "items"))
    return types.select("segment_type", F.inline("items")).withColumnRenamed("value", "segment_value")


query("k13_segment_rows", f"WITH {REGIONS}\nSELECT * EXCLUDE (date) FROM (SELECT * FROM labelled WHERE segment_value IN (SELECT v FROM best WHERE n = 1)\nUNION ALL {COLUMNS})", "jobs_v", rounded=PAID)(segment_rows)

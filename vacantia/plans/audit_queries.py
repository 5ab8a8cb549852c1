"""Audit statistics and reporting views over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.operators import audit
from vacantia.plans.bindings import AS_OF
from vacantia.plans.registry import query

T = f"TIMESTAMP '{AS_OF}'"
RATIO = "round(CAST(count(*) FILTER (compliance_status = 'approved') AS DOUBLE) / nullif(count(*), 0) * 100, {})"
SEEN = "SELECT DISTINCT j.job_id, j.compliance_status, j.first_seen_at, j.remote_class, j.geo_class, js.source FROM jobs_v j JOIN job_sources_v js ON js.job_id = j.job_id"

query("a01_compliance_7d", f"""
SELECT count(*) AS total_jobs, count(*) FILTER (compliance_status = 'approved') AS approved, count(*) FILTER (compliance_status = 'review') AS review,
       count(*) FILTER (compliance_status = 'rejected') AS rejected, {RATIO.format(2)} AS approved_ratio_pct
FROM jobs_v WHERE first_seen_at > {T} - INTERVAL 7 DAY""")(lambda t: audit.compliance_stats(t.jobs, AS_OF))

COMPANY_STATS = """
SELECT c.legal_name, count(*) AS total_jobs, count(*) FILTER (j.compliance_status = 'approved') AS approved,
       count(*) FILTER (j.compliance_status = 'rejected') AS rejected,
       round(CAST(count(*) FILTER (j.compliance_status = 'approved') AS DOUBLE) / nullif(count(*), 0) * 100, 2) AS approved_ratio_pct
FROM jobs_v j JOIN companies_v c ON c.company_id = j.company_id GROUP BY c.legal_name HAVING count(*) > {}"""
query("a02_company_stats", COMPANY_STATS.format(5))(lambda t: audit.company_stats(t.jobs, t.companies, 5))

SOURCE_STATS = f"""
SELECT source, count(*) AS total_jobs, count(*) FILTER (compliance_status = 'approved') AS approved, count(*) FILTER (compliance_status = 'rejected') AS rejected,
       {RATIO.format(2)} AS approved_ratio_pct
FROM ({SEEN}) WHERE first_seen_at > {T} - INTERVAL 7 DAY GROUP BY source"""
query("a03_source_7d", SOURCE_STATS)(lambda t: audit.source_stats(t.jobs, t.job_sources, AS_OF))

SOURCE_TREND = f"""
SELECT CAST(date_trunc('week', first_seen_at) AS DATE) AS week, source, count(*) AS total, count(*) FILTER (compliance_status = 'approved') AS approved,
       count(*) FILTER (compliance_status = 'rejected') AS rejected, {RATIO.format(1)} AS approved_ratio_pct
FROM ({SEEN}) WHERE first_seen_at > {T} - INTERVAL 30 DAY AND compliance_status IS NOT NULL GROUP BY 1, 2"""
query("a04_source_trend", SOURCE_TREND)(lambda t: audit.source_trend(t.jobs, t.job_sources, AS_OF))

REASONS = f"""
SELECT s.source, CASE WHEN cr.hard_geo_flag THEN 'hard_geo' WHEN s.remote_class = 'NON_REMOTE' THEN 'non_remote' WHEN s.geo_class = 'NON_EU' THEN 'non_eu_geo' ELSE 'other' END AS reason,
       count(DISTINCT s.job_id) AS count
FROM ({SEEN}) s LEFT JOIN compliance_reports_v cr ON cr.job_id = s.job_id
WHERE s.compliance_status = 'rejected' AND s.first_seen_at > {T} - INTERVAL {{}} DAY GROUP BY 1, 2"""
query("a05_rejection_reasons", REASONS.format(400))(lambda t: audit.rejection_reasons(t.jobs, t.job_sources, t.compliance_reports, AS_OF, 400))

query("a06_audit_facets", "\nUNION ALL ".join(f"SELECT '{c}' AS facet, coalesce({c}, 'null') AS value, count(*) AS count FROM jobs_v GROUP BY coalesce({c}, 'null')" for c in audit.FACETS))(lambda t: audit.facets(t.jobs))

query("a07_source_facet", """
SELECT coalesce(js.source, 'null') AS label, count(DISTINCT j.job_id) AS count
FROM jobs_v j LEFT JOIN job_sources_v js ON js.job_id = j.job_id
WHERE j.status IN ('new', 'active') AND EXISTS (SELECT 1 FROM job_sources_v x WHERE x.job_id = j.job_id AND x.source = 'src3') GROUP BY 1""")(
    lambda t: audit.source_facet(t.jobs.filter(F.col("status").isin("new", "active")).join(t.job_sources.filter("source = 'src3'").select("job_id"), "job_id", "left_semi"), t.job_sources)
)

query("a08_source_values", "SELECT source, count(*) AS count FROM job_sources_v WHERE source IS NOT NULL AND trim(source) <> '' GROUP BY source")(lambda t: audit.source_values(t.job_sources))

query("a09_lifetime", f"""
SELECT avg(s) AS avg_lifetime_s, quantile_cont(s, 0.5) AS median_lifetime_s
FROM (SELECT epoch(last_seen_at) - epoch(first_seen_at) AS s FROM job_sources_v WHERE first_seen_at > {T} - INTERVAL 30 DAY)""")(lambda t: audit.lifetime_stats(t.job_sources, AS_OF))

# The same medians with every group treated as one that no buffer holds.
query("a09_lifetime_by_rank", f"""
SELECT avg(s) AS avg_lifetime_s, quantile_cont(s, 0.5) AS median_lifetime_s
FROM (SELECT epoch(last_seen_at) - epoch(first_seen_at) AS s FROM job_sources_v WHERE first_seen_at > {T} - INTERVAL 4000 DAY)""")(lambda t: audit.lifetime_stats(t.job_sources, AS_OF, 4000, direct=0))

query("f10_ghost_jobs", f"""
SELECT job_id, source, source_job_id, first_seen_at, last_seen_at, epoch(last_seen_at) - epoch(first_seen_at) AS lifetime_s
FROM job_sources_v WHERE first_seen_at > {T} - INTERVAL 400 DAY AND last_seen_at - first_seen_at < INTERVAL 3 DAY""")(lambda t: audit.ghost_jobs(t.job_sources, AS_OF, 3, 400))

REPOST = """j.job_fingerprint = p.job_fingerprint AND j.company_name = p.company_name AND j.title = p.title AND j.job_id <> p.job_id
 AND j.first_seen_at > p.last_seen_at AND j.first_seen_at - p.last_seen_at < INTERVAL 2000 DAY"""
query("j07_repost_candidates", f"""
SELECT j.job_id, j.company_name, j.title, j.first_seen_at, p.last_seen_at AS previous_last_seen_at, epoch(j.first_seen_at) - epoch(p.last_seen_at) AS gap_s
FROM jobs_v j JOIN jobs_v p ON {REPOST} WHERE j.first_seen_at > {T} - INTERVAL 2015 DAY""")(lambda t: audit.repost_candidates(t.jobs, AS_OF, 2000))
query("j08_repost_counts", f"""
SELECT j.job_id, count(p.job_id) AS repost_count FROM jobs_v j LEFT JOIN jobs_v p ON {REPOST} WHERE j.first_seen_at > {T} - INTERVAL 2015 DAY GROUP BY j.job_id""")(lambda t: audit.repost_counts(t.jobs, AS_OF, 2000))

HEALTH = f"""
SELECT ca.company_ats_id, c.legal_name, ca.provider, ca.ats_slug, ca.last_sync_at, ca.created_at{{}}
FROM company_ats_v ca JOIN companies_v c ON c.company_id = ca.company_id
WHERE ca.is_active AND c.is_active AND (ca.last_sync_at < {T} - INTERVAL 3 DAY OR (ca.last_sync_at IS NULL AND ca.created_at < {T} - INTERVAL 3 DAY))"""
query("f15_ats_health", HEALTH.format(""))(lambda t: audit.failing_integrations(t.company_ats, t.companies, AS_OF))

query("a24_pivot_trend", f"""
WITH trend AS ({SOURCE_TREND})
SELECT week, {", ".join(f"max(approved_ratio_pct) FILTER (source = 'src{i}') AS src{i}" for i in range(7))} FROM trend GROUP BY week""", "jobs_v", "job_sources_v")(
    lambda t: audit.trend_pivot(audit.source_trend(t.jobs, t.job_sources, AS_OF), [f"src{i}" for i in range(7)])
)
NAMES = ("hard_geo", "non_remote", "non_eu_geo", "other")
query("a24_pivot_reasons", f"""
WITH reasons AS ({REASONS.format(400)}),
wide AS (SELECT source, {", ".join(f"CAST(coalesce(sum(count) FILTER (reason = '{n}'), 0) AS BIGINT) AS {n}" for n in NAMES)}, CAST(sum(count) AS BIGINT) AS total FROM reasons GROUP BY source)
SELECT *, {", ".join(f"round(CAST({n} AS DOUBLE) / nullif(total, 0) * 100, 1) AS {n}_pct" for n in NAMES)} FROM wide""")(
    lambda t: audit.reason_pivot(audit.rejection_reasons(t.jobs, t.job_sources, t.compliance_reports, AS_OF, 400))
)

# Reporting views.
query("v02_company_stats", COMPANY_STATS.format(10))(lambda t: audit.company_stats(t.jobs, t.companies))
query("v03_source_7d", SOURCE_STATS)(lambda t: audit.source_stats(t.jobs, t.job_sources, AS_OF))
query("v04_source_trend", SOURCE_TREND.replace("AS week, source,", "AS week, source, CAST(30 AS INTEGER) AS window_days,"))(lambda t: audit.source_trend(t.jobs, t.job_sources, AS_OF).withColumn("window_days", F.lit(30)))
query("v05_rejection_reasons", REASONS.format(30).replace("count(DISTINCT s.job_id) AS count", "count(DISTINCT s.job_id) AS count, CAST(30 AS INTEGER) AS window_days"))(
    lambda t: audit.rejection_reasons(t.jobs, t.job_sources, t.compliance_reports, AS_OF).withColumn("window_days", F.lit(30))
)
query("v06_ats_health", HEALTH.format(f", CAST(greatest(0, floor((epoch({T}) - epoch(coalesce(ca.last_sync_at, ca.created_at))) / 86400)) AS INTEGER) AS days_since_sync"))(lambda t: audit.ats_health(t.company_ats, t.companies, AS_OF))

"""Market statistics, segments, series and system metrics over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.operators import market as m
from vacantia.operators.audit import compliance_stats, failing_integrations
from vacantia.plans.bindings import AS_OF, Tables
from vacantia.plans.registry import query

DAY = "1998-05-20"
T, A = f"TIMESTAMP '{DAY}'", f"TIMESTAMP '{AS_OF}'"
IN = "({0} >= " + T + " AND {0} < " + T + " + INTERVAL 1 DAY)"
#: Columns that are means.
PAID, DAYS = ("avg_salary_eur", "median_salary_eur"), ("median_salary_eur", "remote_ratio")
FIRST, LAST = IN.format("first_seen_at"), IN.format("last_seen_at")
REMOTE = "CASE WHEN remote_class IN ('remote_only', 'remote_region_locked') THEN 1e0 ELSE 0e0 END"
DAILY = f"""
SELECT DATE '{DAY}' AS date, j.*, (SELECT avg(epoch(last_seen_at) - epoch(first_seen_at)) FROM job_sources_v WHERE {LAST}) AS avg_job_lifetime_s
FROM (SELECT count(*) FILTER ({FIRST}) AS jobs_created, count(*) FILTER (availability_status = 'expired' AND {LAST}) AS jobs_expired, count(*) FILTER (availability_status = 'active') AS jobs_active,
   count(*) FILTER (is_repost AND {FIRST}) AS jobs_reposted, avg(salary_min_eur) FILTER (availability_status = 'active') AS avg_salary_eur,
   quantile_cont(salary_min_eur, 0.5) FILTER (availability_status = 'active') AS median_salary_eur, avg({REMOTE}) FILTER (availability_status = 'active') AS remote_ratio FROM jobs_v) j"""
query("a10_market_daily", DAILY, rounded=(*PAID, "remote_ratio", "avg_job_lifetime_s"))(lambda t: m.daily_stats(t.jobs, t.job_sources, DAY))


def segment_sql(kind: str, value: str, condition: str) -> str:
    return f"""
SELECT DATE '{DAY}' AS date, '{kind}' AS segment_type, {value} AS segment_value, count(*) FILTER (availability_status = 'active') AS jobs_active, count(*) FILTER ({FIRST}) AS jobs_created,
  count(*) FILTER (salary_min_eur >= 10000) AS salary_count, avg(CASE WHEN salary_min_eur >= 10000 THEN salary_min_eur END) AS avg_salary_eur,
  quantile_cont(CASE WHEN salary_min_eur >= 10000 THEN salary_min_eur END, 0.5) AS median_salary_eur
FROM jobs_v WHERE {condition} AND compliance_status = 'approved' AND compliance_score >= 80 AND (availability_status = 'active' OR {FIRST}) GROUP BY {value}"""


COUNTRY = segment_sql("country", "CASE WHEN geo_class IN ('eu_member_state', 'eu_explicit', 'eu_region') THEN coalesce(remote_scope, geo_class) ELSE 'Non EU' END", "geo_class IS NOT NULL")
COLUMNS = "\nUNION ALL ".join(segment_sql(c, c, f"{c} IS NOT NULL") for c in ("job_family", "seniority"))
query("a11_segments_country", COUNTRY, rounded=PAID)(lambda t: m.country_segments(t.jobs, DAY))
query("a12_segments_family_seniority", COLUMNS, rounded=PAID)(lambda t: m.column_segments(t.jobs, DAY))
query("a10_market_daily_by_rank", DAILY, rounded=(*PAID, "remote_ratio", "avg_job_lifetime_s"))(lambda t: m.daily_stats(t.jobs, t.job_sources, DAY, direct=0))
query("a11_segments_by_rank", COUNTRY, rounded=PAID)(lambda t: m.country_segments(t.jobs, DAY, direct=0))
query("a12_segments_by_rank", COLUMNS, rounded=PAID)(lambda t: m.column_segments(t.jobs, DAY, direct=0))
REGIONS = f"""
c AS ({COUNTRY}),
labelled AS (SELECT * REPLACE (regexp_replace(regexp_replace(segment_value, '(?i)^home\\s+based\\s*[-–]\\s*', 'Remote - '), '(?i)^remote\\s+job\\s*[,\\s]+\\s*', 'Remote - ') AS segment_value)
  FROM c WHERE NOT regexp_matches(lower(segment_value), 'americ|apac|latam|asia pacific')),
labels AS (SELECT DISTINCT segment_value AS v, trim(regexp_replace(regexp_replace(regexp_replace(segment_value, '(?i)^republic\\s+of\\s+', ''), '(?i)^remote\\s*[-–]\\s*', ''), '(?i)\\s*\\(remote\\)\\s*$', '')) AS region FROM labelled),
best AS (SELECT v, row_number() OVER (PARTITION BY region ORDER BY CASE WHEN regexp_matches(v, '(?i)^remote\\s*[-–]') THEN 0 WHEN ends_with(lower(v), ' (remote)') THEN 1 ELSE 2 END, v) AS n FROM labels WHERE region <> '')"""
query("w06_best_label", f"WITH {REGIONS}\nSELECT * FROM labelled WHERE segment_value IN (SELECT v FROM best WHERE n = 1)", "jobs_v", rounded=PAID)(lambda t: m.normalised_regions(m.country_segments(t.jobs, DAY)))


def segments(t: Tables):
    return m.normalised_regions(m.country_segments(t.jobs, DAY)).unionByName(m.column_segments(t.jobs, DAY))


query("u01_all_segments", f"WITH {REGIONS}\nSELECT * FROM labelled WHERE segment_value IN (SELECT v FROM best WHERE n = 1)\nUNION ALL {COLUMNS}", "jobs_v", rounded=PAID)(segments)
query("t10_breakdown_family", f"""
WITH s AS ({COLUMNS}), r AS (SELECT *, row_number() OVER (ORDER BY jobs_active DESC, segment_value) AS place FROM s WHERE segment_type = 'job_family')
SELECT segment_value, jobs_active, CAST(floor(CAST(jobs_active AS DOUBLE) / max(jobs_active) OVER () * 100 + 0.5) AS BIGINT) AS bar_pct,
  CASE WHEN floor(median_salary_eur / 1000 + 0.5) >= 10 AND salary_count >= 3 AND jobs_active > 0 AND salary_count >= 0.25 * jobs_active THEN CAST(floor(median_salary_eur / 1000 + 0.5) AS BIGINT) END AS median_k,
  CAST(place AS INTEGER) AS place
FROM r WHERE place <= 8""", "jobs_v")(lambda t: m.breakdown(m.column_segments(t.jobs, DAY), "job_family"))
query("t10_breakdown_country", f"""
WITH {REGIONS},
s AS (SELECT *, segment_value = 'Non EU' AS apart FROM labelled WHERE segment_value IN (SELECT v FROM best WHERE n = 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY apart ORDER BY jobs_active DESC, segment_value) AS place FROM s),
k AS (SELECT * FROM r WHERE apart OR place <= 7)
SELECT segment_value, jobs_active, CAST(floor(CAST(jobs_active AS DOUBLE) / max(jobs_active) OVER () * 100 + 0.5) AS BIGINT) AS bar_pct,
  CASE WHEN floor(median_salary_eur / 1000 + 0.5) >= 10 AND salary_count >= 3 AND jobs_active > 0 AND salary_count >= 0.25 * jobs_active THEN CAST(floor(median_salary_eur / 1000 + 0.5) AS BIGINT) END AS median_k,
  CAST(place AS INTEGER) AS place FROM k""", "jobs_v")(lambda t: m.breakdown(m.normalised_regions(m.country_segments(t.jobs, DAY)), "country"))
query("a13_active_counts", "SELECT count(*) AS jobs_total, count(*) FILTER (compliance_score >= 80) AS jobs_approved FROM jobs_v WHERE availability_status = 'active'")(lambda t: m.active_counts(t.jobs))
SYSTEM = f"""
SELECT (SELECT count(*) FROM jobs_v) AS jobs_total, (SELECT count(*) FROM jobs_v WHERE first_seen_at >= {A} - INTERVAL 24 HOUR) AS jobs_24h, (SELECT max(last_seen_at) FROM jobs_v) AS last_tick_at,
  (SELECT count(*) FROM companies_v) AS companies_total, (SELECT count(*) FROM company_ats_v) AS company_ats_total, (SELECT count(*) FROM company_ats_v WHERE created_at >= {A} - INTERVAL 24 HOUR) AS company_ats_24h"""
query("a14_system_metrics", SYSTEM)(lambda t: m.system_metrics(t.jobs, t.companies, t.company_ats, AS_OF))
query("v01_overview", f"""
SELECT s.*, w.*, h.* FROM ({SYSTEM}) s,
 (SELECT count(*) FILTER (compliance_status = 'approved') AS approved_7d, count(*) FILTER (compliance_status = 'review') AS review_7d, count(*) FILTER (compliance_status = 'rejected') AS rejected_7d,
   round(CAST(count(*) FILTER (compliance_status = 'approved') AS DOUBLE) / nullif(count(*), 0) * 100, 2) AS approved_ratio_7d FROM jobs_v WHERE first_seen_at > {A} - INTERVAL 7 DAY) w,
 (SELECT count(*) AS ats_health_count FROM company_ats_v ca JOIN companies_v c ON c.company_id = ca.company_id
  WHERE ca.is_active AND c.is_active AND (ca.last_sync_at < {A} - INTERVAL 3 DAY OR (ca.last_sync_at IS NULL AND ca.created_at < {A} - INTERVAL 3 DAY))) h""")(
    lambda t: m.system_metrics(t.jobs, t.companies, t.company_ats, AS_OF)
    .crossJoin(compliance_stats(t.jobs, AS_OF).select(F.col("approved").alias("approved_7d"), F.col("review").alias("review_7d"), F.col("rejected").alias("rejected_7d"), F.col("approved_ratio_pct").alias("approved_ratio_7d")))
    .crossJoin(failing_integrations(t.company_ats, t.companies, AS_OF).agg(F.count(F.lit(1)).alias("ats_health_count")))
)

# A daily series made of events: active users and mean value a day, with gaps.


def series(t: Tables):
    day = F.to_date("ts")
    out = t.read("events").groupBy(day.alias("date")).agg(F.count_distinct("user_id").alias("jobs_active"), (F.sum(F.round(F.col("value") * 100).cast("long")) / (100 * F.count(F.lit(1)))).alias("v"), F.avg(F.when(F.col("event_type") == "click", 1.0).otherwise(0.0)).alias("remote_ratio"))
    return out.withColumn("median_salary_eur", F.when(F.dayofmonth("date") % 4 != 0, F.col("v"))).drop("v")


SERIES = """SELECT date, jobs_active, CASE WHEN extract(day FROM date) % 4 <> 0 THEN v END AS median_salary_eur, remote_ratio FROM (
  SELECT CAST(ts AS DATE) AS date, count(DISTINCT user_id) AS jobs_active, CAST(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS DOUBLE) / (100 * count(*)) AS v, avg(CASE WHEN event_type = 'click' THEN 1e0 ELSE 0e0 END) AS remote_ratio FROM events GROUP BY 1)"""
query("t12_recent_days", f"SELECT * FROM ({SERIES}) WHERE date >= (SELECT max(CAST(ts AS DATE)) FROM events) - 10", rounded=DAYS)(lambda t: (lambda d: d.join(F.broadcast(d.agg(F.max("date").alias("m"))), F.col("date") >= F.date_sub("m", 10)).drop("m"))(series(t)))
query("a23_period_metrics", f"SELECT arg_max(jobs_active, date) AS total_active, avg(median_salary_eur) AS median_salary, avg(remote_ratio) AS remote_ratio FROM (SELECT * FROM ({SERIES}) ORDER BY date DESC LIMIT 7)", rounded=("median_salary", "remote_ratio"))(lambda t: m.period_metrics(series(t), 7))
query("w07_interpolate", f"""
WITH n AS (SELECT *, row_number() OVER (ORDER BY date) AS i FROM ({SERIES})), k AS (SELECT *, CASE WHEN median_salary_eur IS NOT NULL THEN i END AS a FROM n),
e AS (SELECT *, last_value(a IGNORE NULLS) OVER b AS i0, last_value(median_salary_eur IGNORE NULLS) OVER b AS v0, first_value(a IGNORE NULLS) OVER f AS i1, first_value(median_salary_eur IGNORE NULLS) OVER f AS v1 FROM k
  WINDOW b AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT date, jobs_active, coalesce(median_salary_eur, v0 + (v1 - v0) * (i - i0) / nullif(i1 - i0, 0), v0, v1) AS median_salary_eur, remote_ratio FROM e""", rounded=DAYS)(lambda t: m.interpolated(series(t), "date", "median_salary_eur"))
query("m06_scaled", f"SELECT *, coalesce(10 + 90 * (remote_ratio - min(remote_ratio) OVER ()) / nullif(max(remote_ratio) OVER () - min(remote_ratio) OVER (), 0), 55) AS scaled FROM ({SERIES})", rounded=(*DAYS, "scaled"))(lambda t: m.scaled(series(t), "remote_ratio", 10.0, 100.0))
query("a22_remote_ratio", f"""
SELECT date, jobs_active, median_salary_eur, CASE WHEN r IS NOT DISTINCT FROM 0e0 THEN (SELECT avg({REMOTE}) FROM jobs_v WHERE availability_status = 'active') ELSE r END AS remote_ratio
FROM (SELECT *, CASE WHEN extract(day FROM date) % 2 = 0 THEN 0e0 ELSE remote_ratio END AS r FROM ({SERIES}))""", rounded=DAYS)(lambda t: m.backfilled_ratio(series(t).withColumn("remote_ratio", F.when(F.dayofmonth("date") % 2 == 0, 0.0).otherwise(F.col("remote_ratio"))), t.jobs))
query("k06_freeze_day", f"SELECT * FROM ({SERIES})", rounded=DAYS)(lambda t: (lambda d: m.keep_first(d.filter(F.dayofmonth("date") > 9), d.filter(F.dayofmonth("date") <= 9).unionByName(d.filter(F.dayofmonth("date") > 20).withColumn("jobs_active", F.lit(0).cast("long"))), "date"))(series(t)))
query("k07_refresh_segments", f"SELECT * REPLACE (CASE WHEN segment_type = 'seniority' THEN CAST(-1 AS BIGINT) ELSE jobs_active END AS jobs_active) FROM ({COLUMNS})", "jobs_v", rounded=PAID)(
    lambda t: (lambda x: m.replace_by_key(x, x.filter("segment_type = 'seniority'").withColumn("jobs_active", F.lit(-1).cast("long")), "date", "segment_type", "segment_value"))(m.column_segments(t.jobs, DAY))
)
query("t08_latest_snapshot", f"""
WITH two AS (SELECT * FROM ({COLUMNS}) UNION ALL SELECT * REPLACE (date - 1 AS date) FROM ({COLUMNS}))
SELECT segment_type, segment_value, jobs_active, jobs_created, salary_count, avg_salary_eur, median_salary_eur FROM two WHERE date = (SELECT max(date) FROM two)""", "jobs_v", rounded=PAID)(
    lambda t: (lambda x: m.latest_snapshot(x.unionByName(x.withColumn("date", F.date_sub("date", 1)))))(m.column_segments(t.jobs, DAY))
)

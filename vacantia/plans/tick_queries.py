"""A whole tick, a whole discovery run, a preview and the reporting views over the bound tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from vacantia.operators import market
from vacantia.plans import ingest, tick
from vacantia.plans.bindings import MID
from vacantia.plans.registry import ORACLES, QUERIES, query
from vacantia.plans.source_queries import CASES
from vacantia.plans.state_queries import EU
from vacantia.plans.table_queries import rows
from vacantia.streaming.tick import shared_folder

DAY = MID[:10]
STEPS = ("ingestion", "lifecycle", "availability", "market_metrics", "maintenance", "frontend_export", "audit_export")
DISCOVERY = ("sources", "careers", "ats_reverse", "ats_guessing", "dorking", "dorking_crt", "slug_harvest", "promote_discovered")


def outcomes(t, done: list[tick.Outcome]):
    return t.spark.createDataFrame([(n, o.step, o.ok, None if o.ok else str(o.result)) for n, o in enumerate(done)], "n int, step string, ok boolean, error string")


def expected(names: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT {n} AS n, '{name}' AS step, true AS ok, CAST(NULL AS VARCHAR) AS error" for n, name in enumerate(names))


def started(t) -> tick.Versions:
    v = tick.Versions(t.spark, shared_folder(t.spark, "whole-tick"))
    for name in ("jobs", "job_sources", "companies", "company_ats", "compliance_reports"):
        v.put(name, getattr(t, name))
    return v


#: What is stored: a tenth of the jobs has no resolution yet, a seventh a salary that only its text tells.
STORED = """SELECT j.*, CASE WHEN k % 10 = 3 THEN 'US only' WHEN k % 7 = 2 THEN 'Salary 50000 - 60000 EUR per year' ELSE 'Text' END AS description, CAST(NULL AS INT) AS salary_min, CAST(NULL AS INT) AS salary_max, CAST(NULL AS VARCHAR(20)) AS salary_currency,
  CAST(NULL AS VARCHAR(20)) AS salary_period, CASE WHEN k % 2 = 0 THEN 'own' END AS source_department FROM jobs_v j"""
#: What arrives, twice for some: every seventh job, with a payload.
ARRIVING = """SELECT job_id, k, CAST(company_id AS VARCHAR(20)) AS company_id, company_name, CASE WHEN k % 2 = 0 THEN 'Fully Remote Backend Engineer' ELSE 'Onsite Engineer' END AS title, CASE WHEN k % 4 < 2 THEN 'Spain' ELSE 'APAC' END AS remote_scope,
  CASE WHEN k % 3 = 0 THEN 'US only' ELSE 'Build things, up to 60000 EUR' END AS description, source, CAST(NULL AS VARCHAR(20)) AS department, 'new' AS status, first_seen_at,
  CAST(NULL AS INT) AS salary_min, CAST(NULL AS INT) AS salary_max, CAST(NULL AS VARCHAR(20)) AS salary_currency, CAST(NULL AS VARCHAR(20)) AS salary_period, '{"id": 1}' AS payload FROM jobs_v WHERE k % 7 = 0"""
_RUNS: dict = {}


def whole_tick(t) -> tuple[tick.Versions, list[tick.Outcome]]:
    """One tick over the stored tables; a session runs it once for each folder, whichever of its results are asked for."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key in _RUNS:
        return _RUNS[key]
    v = started(t)
    # Resolutions of the version in force stand; those of the tenth without one are made by the backfill.
    version = F.when(F.col("k") % 10 != 3, "v1")
    v.put("jobs", rows(t, STORED).withColumn("policy_version", version).withColumn("company_id", F.col("company_id").cast("string")))
    v.put("companies", v.get("companies").withColumn("company_id", F.col("company_id").cast("string")))
    v.put("compliance_reports", v.get("compliance_reports").withColumn("job_uid", F.col("job_id")))
    v.put("daily_stats", market.daily_stats(t.jobs, t.job_sources, "1998-05-31"))
    v.put("segments", market.country_segments(t.jobs, "1998-05-31"))
    arriving = ingest.spread(rows(t, ARRIVING))
    known = common_cut(v, "processed", ingest.process(arriving, "v1").drop("payload", "k"))
    known = known.union(known.filter(F.col("job_id").cast("long") % 2 == 1))
    probes = t.jobs.filter("k % 3 = 0").select("job_id", F.lit("active").alias("availability_status"), F.lit(MID).cast("timestamp_ntz").alias("verified_at"), F.lit(False).alias("failure"))
    departments = t.jobs.select("job_id", F.lit("found").alias("department"))
    _RUNS[key] = v, tick.run_steps(tick.tick_steps(v, MID, DAY, known, t.job_sources.filter("seen_count = 3"), probes, "v1", departments))
    return _RUNS[key]


def common_cut(v: tick.Versions, name: str, frame):
    v.put(name, frame)
    return v.get(name)


query("o01_tick", expected(STEPS))(lambda t: outcomes(t, whole_tick(t)[1]))
STATE_AFTER = """
WITH m AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'new' ELSE status END AS s0 FROM jobs_v),
l AS (SELECT *, CASE WHEN s0 <> 'expired' AND (verification_failures >= 3 OR coalesce(availability_status = 'expired', false) OR coalesce(last_verified_at < {m} - INTERVAL 30 DAY, false)) THEN 'expired'
 WHEN s0 = 'active' AND last_verified_at < {m} - INTERVAL 7 DAY THEN 'stale' WHEN s0 = 'new' AND first_seen_at < {m} - INTERVAL 1 DAY THEN 'active'
 WHEN s0 = 'stale' AND availability_status = 'active' AND last_verified_at >= {m} - INTERVAL 7 DAY THEN 'active' ELSE s0 END AS s1 FROM m)
SELECT job_id, s1 AS status, CASE WHEN k % 3 = 0 THEN 'active' ELSE availability_status END AS availability_status, CAST(CASE WHEN k % 3 = 0 THEN 0 ELSE verification_failures END AS INTEGER) AS verification_failures,
  CASE WHEN k % 7 = 0 THEN CASE WHEN k % 3 <> 0 AND k % 2 = 0 AND k % 4 < 2 THEN 'approved' ELSE 'rejected' END WHEN k % 10 = 3 OR compliance_status IS NULL OR compliance_score IS NULL THEN {anew} ELSE compliance_status END AS compliance_status,
  CASE WHEN k % 7 = 2 AND k % 10 <> 3 THEN 50000 END AS salary_min, CASE WHEN k % 2 = 0 THEN 'own' ELSE 'found' END AS source_department FROM l WHERE k % 7 <> 0 OR k % 3 = 0"""
#: Onsite titles don't occur among the stored ones; of those, scope and description decide.
ANEW = "CASE WHEN k % 10 = 3 THEN 'rejected' ELSE CASE CAST(k % 9 AS INT) WHEN 0 THEN 'approved' WHEN 1 THEN 'approved' WHEN 2 THEN 'review' WHEN 3 THEN 'review' WHEN 4 THEN 'rejected' WHEN 5 THEN 'approved' WHEN 6 THEN 'approved' WHEN 7 THEN 'review' ELSE 'rejected' END END"
query("o01_tick_jobs", STATE_AFTER.replace("{m}", f"TIMESTAMP '{MID}'").replace("{anew}", ANEW), "jobs_v")(
    lambda t: whole_tick(t)[0].get("jobs").filter("k % 7 <> 0 OR k % 3 = 0").select("job_id", "status", "availability_status", "verification_failures", "compliance_status", "salary_min", "source_department")
)
query("o01_tick_snapshots", f"SELECT job_id, title, job_fingerprint, status, TIMESTAMP '{MID}' AS captured_at FROM jobs_v WHERE k % 7 = 0")(lambda t: whole_tick(t)[0].get("job_snapshots").select("job_id", "title", "job_fingerprint", "status", "captured_at"))
query("o01_tick_reports", f"""
WITH a AS (SELECT arg_max(k, job_id) AS k, max(job_id) AS job_id FROM jobs_v WHERE k % 7 = 0 GROUP BY company_id, k % 2, k % 4 < 2)
SELECT job_id, policy_version, hard_geo_flag, CAST(NULL AS INTEGER) AS final_score, CAST(NULL AS VARCHAR) AS final_status, CAST(NULL AS TIMESTAMP) AS created_at FROM compliance_reports_v
UNION ALL SELECT job_id, 'v1', k % 3 = 0, CAST(CASE WHEN k % 3 <> 0 AND k % 2 = 0 AND k % 4 < 2 THEN 100 ELSE 0 END AS INTEGER), CASE WHEN k % 3 <> 0 AND k % 2 = 0 AND k % 4 < 2 THEN 'approved' ELSE 'rejected' END, TIMESTAMP '{MID}' FROM a""", "jobs_v", "compliance_reports_v")(
    # A report belongs to what a posting says (its company, title and scope) and a policy; of a batch the last one counts.
    lambda t: whole_tick(t)[0].get("compliance_reports").select("job_id", "policy_version", "hard_geo_flag", "final_score", "final_status", "created_at")
)
query("o01_tick_companies", f"""
WITH j AS (SELECT *, CASE WHEN k % 7 = 0 THEN CASE WHEN k % 3 <> 0 AND k % 2 = 0 AND k % 4 < 2 THEN 'approved' ELSE 'rejected' END ELSE compliance_status END AS now_status,
  CASE WHEN k % 7 = 0 THEN CASE WHEN k % 3 = 0 THEN 'not_disclosed' ELSE {{told}} END ELSE salary_transparency_status END AS told FROM jobs_v),
n AS (SELECT CAST(c.company_id AS VARCHAR) AS company_id, CASE WHEN count(j.job_id) FILTER (j.remote_source_flag) >= 3 AND c.remote_posture = 'UNKNOWN' THEN 'REMOTE_FRIENDLY' ELSE c.remote_posture END AS remote_posture, c.eu_entity_verified, c.hq_country, count(j.job_id) AS t,
  count(j.job_id) FILTER (j.now_status = 'approved') AS a, count(j.job_id) FILTER (j.now_status = 'rejected') AS r, count(j.job_id) FILTER (j.told = 'disclosed') AS d
  FROM companies_v c LEFT JOIN j ON j.company_id = c.company_id GROUP BY c.company_id, c.remote_posture, c.eu_entity_verified, c.hq_country)
SELECT company_id, remote_posture, a AS approved_jobs_count, r AS rejected_jobs_count, t AS total_jobs_count, CAST(round((CASE remote_posture WHEN 'REMOTE_ONLY' THEN 40 WHEN 'REMOTE_FRIENDLY' THEN 20 ELSE 0 END + CASE WHEN eu_entity_verified THEN 25 ELSE 0 END + CASE WHEN hq_country IN ({EU}) THEN 20 ELSE 0 END
  + CASE WHEN t > 0 AND CAST(a AS DOUBLE) / t >= 0.8 THEN 15 WHEN t > 0 AND CAST(a AS DOUBLE) / t >= 0.5 THEN 8 ELSE 0 END) * CASE WHEN t > 0 AND CAST(d AS DOUBLE) / t >= 0.5 THEN 1.2 ELSE 1.0 END) AS INTEGER) AS signal_score FROM n""".replace("{told}", "'disclosed'"), "jobs_v", "companies_v")(
    lambda t: whole_tick(t)[0].get("companies").select("company_id", "remote_posture", "approved_jobs_count", "rejected_jobs_count", "total_jobs_count", "signal_score")
)
# A case is appended for every posting that arrives, the repeated ones included.
query("o01_tick_salary_cases", "SELECT job_id, 60000 AS salary_min, 60000 AS salary_max FROM jobs_v WHERE k % 7 = 0 AND k % 3 <> 0 UNION ALL SELECT job_id, 60000, 60000 FROM jobs_v WHERE k % 7 = 0 AND k % 3 <> 0 AND k % 2 = 1", "jobs_v")(lambda t: whole_tick(t)[0].get("salary_cases").select("job_id", "salary_min", "salary_max"))


def discovery_run(t):
    """One run of discovery over all companies, likewise once a session and folder."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir, "discovery")
    if key not in _RUNS:
        _RUNS[key] = _discovery_run(t)
    return _RUNS[key]


def _discovery_run(t):
    make = t.spark.createDataFrame
    v = tick.Versions(t.spark, shared_folder(t.spark, "discovery"))
    v.put("companies", t.companies.select(F.col("company_id").cast("string").alias("company_id"), "legal_name", "careers_url", "ats_provider", "is_active"))
    v.put("discovered_slugs", make([("lever", "known", "old", "promoted")], "provider string, slug string, discovery_source string, status string"))
    done = tick.run_steps(tick.discovery_steps(
        v, make([("Acme Inc",), ("Acme INC",)], "name string"), make([("https://jobs.lever.co/acme", ""), ("", "nothing")], "redirect string, page string"),
        make([("https://boards.greenhouse.io/big/1", "greenhouse"), ("nonsense", "lever")], "url string, provider string"), make([("*.solo.recruitee.com",)], "name_value string"),
        make([("zeta",), ("# no",)], "value string"), make([("https://duo.traffit.com", "final_url")], "text string, evidence string"),
        make([("ashby", "acmehq", True, True), ("lever", "acme", False, True), ("traffit", "duo", True, True)], "provider string, slug string, passed boolean, has_token boolean"),
    ))
    return v, done


query("o02_discovery", expected(DISCOVERY))(lambda t: outcomes(t, discovery_run(t)[1]))
SLUGS = [("lever", "known", "old", "promoted"), ("lever", "acme", "careers", "rejected"), ("ashby", "acmehq", "ats_guessing", "promoted"), ("greenhouse", "big", "dorking", "pending"), ("recruitee", "solo", "dorking_crt", "pending"), ("traffit", "duo", "slug_harvest", "promoted")]
query("o02_discovered_slugs", " UNION ALL ".join(f"SELECT '{p}' AS provider, '{s}' AS slug, '{d}' AS discovery_source, '{k}' AS status" for p, s, d, k in SLUGS))(lambda t: discovery_run(t)[0].get("discovered_slugs").filter("discovery_source <> 'ats_reverse'"))
query("o04_preview")(lambda t: tick.preview(t.spark.createDataFrame([("acme-corp", json.dumps(CASES["s03_greenhouse"][1]))], "slug string, payload string"), "greenhouse", "2024-06-01", "v1", "7"))


#: Reporting views by the names of the queries that build them.
VIEWS = ("v01_overview", "v02_company_stats", "v03_source_7d", "v04_source_trend", "v05_rejection_reasons", "v06_ats_health", "v07_companies", "v08_jobs")


def create_views(spark, sf_dir: str) -> list[str]:
    """The eight reporting views as temporary views of the session, under their names without the number."""
    names = []
    for name in VIEWS:
        QUERIES[name](spark, sf_dir).createOrReplaceTempView(name.split("_", 1)[1])
        names.append(name.split("_", 1)[1])
    return names


query("k17_views", " UNION ALL ".join(f"SELECT '{n.split('_', 1)[1]}' AS name, (SELECT count(*) FROM ({ORACLES[n]})) AS n" for n in VIEWS))(
    lambda t: t.spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in create_views(t.spark, t.sf_dir)))
)

"""State transitions over the bound tables: one part of them is what is stored, another what arrives."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.operators import state as s
from vacantia.plans.bindings import AS_OF, MID, Tables
from vacantia.plans.registry import query
from vacantia.streaming.keyed_state import KeyedState
from vacantia.streaming.tick import shared_folder

M = f"TIMESTAMP '{MID}'"
STATUS = f"""CASE WHEN status <> 'expired' AND (verification_failures >= 3 OR coalesce(availability_status = 'expired', false) OR coalesce(last_verified_at < {M} - INTERVAL 30 DAY, false)) THEN 'expired'
 WHEN status = 'active' AND last_verified_at < {M} - INTERVAL 7 DAY THEN 'stale' WHEN status = 'new' AND first_seen_at < {M} - INTERVAL 1 DAY THEN 'active'
 WHEN status = 'stale' AND availability_status = 'active' AND last_verified_at >= {M} - INTERVAL 7 DAY THEN 'active' ELSE status END"""
query("d04_lifecycle", f"SELECT job_id, {STATUS} AS status FROM jobs_v")(lambda t: s.lifecycle(t.jobs, MID).select("job_id", "status"))
query("d04_lifecycle_counts", f"SELECT old, new, count(*) AS n FROM (SELECT status AS old, {STATUS} AS new FROM jobs_v) GROUP BY ALL")(lambda t: t.jobs.select(F.col("status").alias("old"), s.next_status(MID).alias("new")).groupBy("old", "new").agg(F.count(F.lit(1)).alias("n")))
query("d05_reposts", f"""
WITH c AS (SELECT j.job_id, count(p.job_id) AS n FROM jobs_v j LEFT JOIN jobs_v p ON j.job_fingerprint = p.job_fingerprint AND j.company_name = p.company_name AND j.title = p.title AND j.job_id <> p.job_id
  AND j.first_seen_at > p.last_seen_at AND j.first_seen_at - p.last_seen_at < INTERVAL 500 DAY WHERE j.first_seen_at > TIMESTAMP '{AS_OF}' - INTERVAL 515 DAY GROUP BY j.job_id)
SELECT j.job_id, coalesce(c.n > 0, j.is_repost) AS is_repost, CAST(coalesce(c.n, j.repost_count) AS BIGINT) AS repost_count FROM jobs_v j LEFT JOIN c ON c.job_id = j.job_id""", "jobs_v")(lambda t: s.marked_reposts(t.jobs, AS_OF, 500).select("job_id", "is_repost", "repost_count"))
CODE = "CASE CAST(k % 5 AS INT) WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN NULL WHEN 3 THEN 410 ELSE 200 END"


def probes(t: Tables):
    code = F.expr(CODE)
    return t.jobs.filter("k % 3 = 0").select("job_id", s.availability(code).alias("availability_status"), F.lit(AS_OF).cast("timestamp_ntz").alias("verified_at"), (s.availability(code) == "unreachable").alias("failure"))


AVAIL = f"CASE WHEN ({CODE}) IN (404, 410) THEN 'expired' WHEN ({CODE}) IS NULL OR ({CODE}) >= 500 THEN 'unreachable' ELSE 'active' END"
query("d06_availability", f"""
SELECT job_id, CASE WHEN k % 3 = 0 THEN {AVAIL} ELSE availability_status END AS availability_status, CASE WHEN k % 3 = 0 THEN TIMESTAMP '{AS_OF}' ELSE last_verified_at END AS last_verified_at,
  CAST(CASE WHEN k % 3 <> 0 THEN verification_failures WHEN {AVAIL} = 'unreachable' THEN verification_failures + 1 ELSE 0 END AS INTEGER) AS verification_failures
FROM jobs_v""")(lambda t: s.observed(t.jobs, probes(t)).select("job_id", "availability_status", "last_verified_at", "verification_failures"))
query("s24_probe_outcomes", f"SELECT {AVAIL} AS outcome, count(*) AS n FROM jobs_v GROUP BY 1")(lambda t: t.jobs.groupBy(s.availability(F.expr(CODE)).alias("outcome")).agg(F.count(F.lit(1)).alias("n")))

COLS = "job_id, company_id, source, title, job_fingerprint, status, compliance_status, first_seen_at, last_seen_at, verification_failures"
OLD = f"SELECT {COLS.replace('source,', "CASE WHEN k % 4 = 0 THEN NULL ELSE source END AS source,")} FROM jobs_v WHERE k % 3 <> 0"
NEW = f"SELECT {COLS.replace('source,', "'incoming' AS source,").replace('status,', "'new' AS status,", 1).replace('title,', "CASE WHEN k % 5 = 0 THEN upper(title) || '!' ELSE title END AS title,").replace('first_seen_at,', "first_seen_at - INTERVAL '3' DAY AS first_seen_at,").replace(', verification_failures', '')} FROM jobs_v WHERE k % 3 <> 1"


def old_new(t: Tables):
    return tuple(t.spark.sql(text.replace("jobs_v", "{jobs}"), jobs=t.jobs) for text in (OLD, NEW))


D01 = f"""
WITH o AS ({OLD}), n AS ({NEW})
SELECT coalesce(o.job_id, n.job_id) AS job_id, coalesce(o.company_id, n.company_id) AS company_id, coalesce(o.source, n.source) AS source, {", ".join(f"CASE WHEN n.job_id IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in ("title", "job_fingerprint", "status", "compliance_status", "last_seen_at"))},
  least(o.first_seen_at, n.first_seen_at) AS first_seen_at, o.verification_failures
FROM o FULL JOIN n ON o.job_id = n.job_id"""
query("d01_job_merge", D01, "jobs_v")(lambda t: s.merged_jobs(*old_new(t)))


def bucketed(t: Tables, keys: list[str], old, new, rule):
    """A stored table in buckets of its keys, of which only those that a batch touches are read and rewritten."""
    table = KeyedState(t.spark, f"{shared_folder(t.spark, 'bucketed')}/state", old.schema, keys, n_buckets=64)
    table.merge(old, lambda before, rows: rows)
    table.merge(new, rule, "batch", 0)
    return table.read()


query("d01_bucketed_merge", D01, "jobs_v")(lambda t: bucketed(t, ["job_id"], *old_new(t), s.merged_jobs))
query("d02_snapshots", f"WITH o AS ({OLD}), n AS ({NEW}) SELECT o.* FROM o JOIN n ON o.job_id = n.job_id WHERE o.title IS DISTINCT FROM n.title OR o.job_fingerprint IS DISTINCT FROM n.job_fingerprint", "jobs_v")(lambda t: s.snapshots(*old_new(t)))
query("d02_snapshots_repeated", f"WITH o AS ({OLD}), n AS ({NEW}) SELECT o.job_id, o.title, TIMESTAMP '{AS_OF}' AS captured_at FROM o JOIN n ON o.job_id = n.job_id WHERE o.title IS DISTINCT FROM n.title OR o.job_fingerprint IS DISTINCT FROM n.job_fingerprint", "jobs_v")(
    # Every job arrives three times; what it was before is kept once.
    lambda t: (lambda old, new: s.snapshots(old, new.union(new).union(new), captured_at=AS_OF).select("job_id", "title", "captured_at"))(*old_new(t))
)
SRC = "source, source_job_id, job_id, first_seen_at, last_seen_at, seen_count"
D03 = f"""
WITH o AS (SELECT source, source_job_id, min(job_id) AS job_id, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at, max(seen_count) AS seen_count FROM job_sources_v WHERE seen_count <= 3 GROUP BY ALL),
n AS (SELECT source, source_job_id, min('x' || job_id) AS job_id, min(first_seen_at) AS first_seen_at, max(last_seen_at) + INTERVAL '9' DAY AS last_seen_at, count(*) AS m FROM job_sources_v WHERE seen_count >= 3 GROUP BY ALL)
SELECT coalesce(o.source, n.source) AS source, coalesce(o.source_job_id, n.source_job_id) AS source_job_id, coalesce(n.job_id, o.job_id) AS job_id, least(o.first_seen_at, n.first_seen_at) AS first_seen_at,
  coalesce(n.last_seen_at, o.last_seen_at) AS last_seen_at, CAST(coalesce(o.seen_count, 0) + coalesce(n.m, 0) AS INTEGER) AS seen_count
FROM o FULL JOIN n ON o.source = n.source AND o.source_job_id = n.source_job_id"""


def sightings(t: Tables):
    """Stored and incoming sources of jobs."""
    stored = t.job_sources.filter("seen_count <= 3").groupBy("source", "source_job_id").agg(F.min("job_id").alias("job_id"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.max("seen_count").alias("seen_count"))
    return stored, t.job_sources.filter("seen_count >= 3").withColumns({"job_id": F.concat(F.lit("x"), "job_id"), "last_seen_at": F.col("last_seen_at") + F.expr("INTERVAL 9 DAYS")})


query("d03_source_merge", D03, "job_sources_v")(lambda t: s.merged_sources(*sightings(t), F.col("last_seen_at")))
query("d03_bucketed_merge", D03, "job_sources_v")(lambda t: bucketed(t, ["source", "source_job_id"], *sightings(t), lambda old, new: s.merged_sources(old, new, F.col("last_seen_at"))))
query("j16_canonical_resolution", """
WITH stored AS (SELECT * FROM jobs_v WHERE k % 2 = 0), mapped AS (SELECT source, source_job_id, min(job_id) AS s FROM job_sources_v WHERE seen_count = 1 GROUP BY ALL),
i AS (SELECT k AS position, concat('in', job_id) AS job_id, concat(job_fingerprint, CASE WHEN k % 3 = 0 THEN '#' ELSE '' END) AS job_fingerprint, concat('src', CAST(k % 7 AS VARCHAR(10))) AS source, concat(job_id, '-1') AS source_job_id FROM jobs_v WHERE k % 2 = 1),
p AS (SELECT job_fingerprint, min(job_id) AS f FROM stored GROUP BY 1),
r AS (SELECT i.position, i.job_id, i.job_fingerprint, coalesce(p.f, mapped.s, i.job_id) AS id FROM i LEFT JOIN p ON p.job_fingerprint = i.job_fingerprint LEFT JOIN mapped ON mapped.source = i.source AND mapped.source_job_id = i.source_job_id)
SELECT position, job_id, job_fingerprint, first_value(id) OVER (PARTITION BY job_fingerprint ORDER BY position) AS canonical_id FROM r""", "jobs_v", "job_sources_v")(
    lambda t: s.canonical_ids(
        t.jobs.filter("k % 2 = 1").select(F.col("k").alias("position"), F.concat(F.lit("in"), "job_id").alias("job_id"), F.concat("job_fingerprint", F.when(F.col("k") % 3 == 0, "#").otherwise("")).alias("job_fingerprint"), F.expr("concat('src', CAST(k % 7 AS STRING))").alias("source"), F.concat("job_id", F.lit("-1")).alias("source_job_id")),
        t.jobs.filter("k % 2 = 0"),
        t.job_sources.filter("seen_count = 1"),
    )
)
query("a15_company_rollup", """
SELECT c.company_id, count(j.job_id) FILTER (j.compliance_status = 'approved') AS approved_jobs_count, count(j.job_id) FILTER (j.compliance_status = 'rejected') AS rejected_jobs_count, count(j.job_id) AS total_jobs_count,
  max(j.first_seen_at) FILTER (j.status = 'active') AS last_active_job_at, CASE WHEN count(j.job_id) FILTER (j.remote_source_flag) >= 3 AND c.remote_posture = 'UNKNOWN' THEN 'REMOTE_FRIENDLY' ELSE c.remote_posture END AS remote_posture
FROM companies_v c LEFT JOIN jobs_v j ON j.company_id = c.company_id GROUP BY c.company_id, c.remote_posture""")(
    lambda t: s.company_figures(t.companies, t.jobs).select("company_id", "approved_jobs_count", "rejected_jobs_count", "total_jobs_count", "last_active_job_at", "remote_posture")
)
EU = ", ".join(f"'{c}'" for c in s.EU_COUNTRIES)
query("a16_signal_score", f"""
WITH n AS (SELECT c.company_id, c.remote_posture, c.eu_entity_verified, c.hq_country, count(j.job_id) AS t, count(j.job_id) FILTER (j.compliance_status = 'approved') AS a, count(j.job_id) FILTER (j.salary_transparency_status = 'disclosed') AS d
  FROM companies_v c LEFT JOIN jobs_v j ON j.company_id = c.company_id GROUP BY ALL)
SELECT company_id, CAST(round((CASE remote_posture WHEN 'REMOTE_ONLY' THEN 40 WHEN 'REMOTE_FRIENDLY' THEN 20 ELSE 0 END + CASE WHEN eu_entity_verified THEN 25 ELSE 0 END + CASE WHEN hq_country IN ({EU}) THEN 20 ELSE 0 END
  + CASE WHEN t > 0 AND CAST(a AS DOUBLE) / t >= 0.8 THEN 15 WHEN t > 0 AND CAST(a AS DOUBLE) / t >= 0.5 THEN 8 ELSE 0 END) * CASE WHEN t > 0 AND CAST(d AS DOUBLE) / t >= 0.5 THEN 1.2 ELSE 1.0 END) AS INTEGER) AS score FROM n""")(lambda t: s.signal_scores(t.companies, t.jobs))
query("d07_company_changed", f"""
SELECT c.company_id FROM companies_v c JOIN (SELECT company_id, count(*) AS n FROM jobs_v GROUP BY 1) j ON j.company_id = c.company_id WHERE coalesce(c.total_jobs_count, -1) <> n""")(
    lambda t: s.company_figures(t.companies, t.jobs).filter("total_jobs_count > 0").join(t.companies.select("company_id", F.col("total_jobs_count").alias("before")), "company_id").filter("coalesce(before, -1) <> total_jobs_count").select("company_id")
)
query("w01_fingerprint_rank", f"""
SELECT job_id, CASE WHEN row_number() OVER (PARTITION BY job_fingerprint ORDER BY coalesce(last_seen_at, first_seen_at, TIMESTAMP '{AS_OF}') DESC, job_id) > 1 THEN md5(concat(job_fingerprint, '|', job_id)) ELSE job_fingerprint END AS job_fingerprint FROM jobs_v""")(
    lambda t: s.ranked_fingerprints(t.jobs, AS_OF).select("job_id", "job_fingerprint")
)
NORM = "lower(regexp_replace(trim(company_name), '\\s+', ' ', 'g'))"
query("w03_oldest_name", f"SELECT job_id, {NORM} AS name FROM jobs_v QUALIFY row_number() OVER (PARTITION BY {NORM} ORDER BY first_seen_at NULLS LAST, job_id) = 1")(
    lambda t: (lambda name: s.first_of_each(t.jobs, name, F.asc_nulls_last("first_seen_at"), F.asc("job_id")).select("job_id", name.alias("name")))(F.lower(F.regexp_replace(F.trim("company_name"), r"\s+", " ")))
)
query("w04_keep_first", "SELECT job_id, job_fingerprint FROM jobs_v QUALIFY row_number() OVER (PARTITION BY job_fingerprint ORDER BY first_seen_at, job_id) = 1")(lambda t: s.first_of_each(t.jobs, F.col("job_fingerprint"), F.asc("first_seen_at"), F.asc("job_id")).select("job_id", "job_fingerprint"))
query("d09_quota", "SELECT user_id AS key, CAST(ts AS DATE) AS day, count(*) AS calls, greatest(count(*) - 2, 0) AS rejected FROM events GROUP BY 1, 2")(lambda t: s.quota_use(t.read("events").select(F.col("user_id").alias("key"), F.to_date("ts").alias("day")), 2))
query("f13_backfill_queue", "SELECT job_id FROM jobs_v WHERE compliance_status IS NULL OR compliance_score IS NULL OR policy_version IS NULL OR policy_version <> 'v1'")(lambda t: t.jobs.filter("compliance_status IS NULL OR compliance_score IS NULL OR policy_version IS NULL OR policy_version <> 'v1'").select("job_id"))
query("f14_verification_queue", f"""
SELECT job_id, status, last_verified_at, verification_failures FROM jobs_v WHERE status IN ('active', 'stale') AND (last_verified_at IS NULL OR last_verified_at < {M} - INTERVAL 6 HOUR)
ORDER BY coalesce(last_verified_at, TIMESTAMP '1970-01-01'), job_id LIMIT 20""")(
    lambda t: t.jobs.filter(F.col("status").isin("active", "stale") & (F.col("last_verified_at").isNull() | (F.col("last_verified_at") < F.lit(MID).cast("timestamp_ntz") - F.expr("INTERVAL 6 HOURS"))))
    .orderBy(F.coalesce("last_verified_at", F.lit("1970-01-01").cast("timestamp_ntz")), "job_id").limit(20).select("job_id", "status", "last_verified_at", "verification_failures")
)
query("j11_anti_backfill", "SELECT c.company_id FROM companies_v c LEFT JOIN company_ats_v a ON a.company_id = c.company_id WHERE a.company_id IS NULL AND c.ats_provider IS NOT NULL")(lambda t: t.companies.filter("ats_provider IS NOT NULL").join(t.company_ats, "company_id", "left_anti").select("company_id"))
query("j13_not_exists", "SELECT source, source_job_id FROM job_sources_v a WHERE seen_count <= 2 AND NOT EXISTS (SELECT 1 FROM job_sources_v b WHERE b.seen_count > 4 AND b.job_id = a.job_id)")(lambda t: t.job_sources.filter("seen_count <= 2").join(t.job_sources.filter("seen_count > 4").select("job_id"), "job_id", "left_anti").select("source", "source_job_id"))
query("j14_normalised_name", f"SELECT j.job_id, c.company_id AS found FROM jobs_v j JOIN companies_v c ON {NORM} = lower(regexp_replace(trim(c.legal_name), '\\s+', ' ', 'g'))")(
    lambda t: (lambda n: t.jobs.select("job_id", n("company_name").alias("n")).join(t.companies.select(F.col("company_id").alias("found"), n("legal_name").alias("n")), "n").drop("n"))(lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " ")))
)
PROVIDERS = ("greenhouse", "lever", "ashby", "workable", "smartrecruiters", "recruitee", "teamtailor")
VALUES = ", ".join(f"('{p}')" for p in PROVIDERS)
query("j18_cross_anti", f"SELECT p.provider, s.ats_slug FROM (VALUES {VALUES}) p(provider), (SELECT DISTINCT ats_slug FROM company_ats_v) s WHERE NOT EXISTS (SELECT 1 FROM company_ats_v a WHERE a.provider = p.provider AND a.ats_slug = s.ats_slug)")(
    lambda t: t.company_ats.select("ats_slug").distinct().withColumn("provider", F.explode(F.array(*map(F.lit, PROVIDERS)))).join(t.company_ats.select("provider", "ats_slug"), ["provider", "ats_slug"], "left_anti")
)
query("j19_first_provider", f"""
SELECT company_id, provider FROM (SELECT c.company_id, p.provider, row_number() OVER (PARTITION BY c.company_id ORDER BY p.n) AS r
  FROM companies_v c JOIN (SELECT unnest(['greenhouse', 'lever', 'ashby', 'workable', 'smartrecruiters', 'recruitee', 'teamtailor']) AS provider, unnest(range(7)) AS n) p ON (c.company_id + p.n) % 3 = 0) WHERE r = 1""")(
    lambda t: (lambda hit: t.companies.select("company_id", hit.alias("provider")).filter("provider IS NOT NULL"))(F.coalesce(*[F.when((F.col("company_id") + i) % 3 == 0, F.lit(p)) for i, p in enumerate(PROVIDERS)]))
)
query("d10_collision_merge", """
WITH t AS (SELECT job_id, first_value(job_id) OVER (PARTITION BY job_fingerprint ORDER BY first_seen_at NULLS LAST, job_id) AS target FROM jobs_v)
SELECT DISTINCT s.source, s.source_job_id, coalesce(t.target, s.job_id) AS job_id FROM job_sources_v s LEFT JOIN t ON t.job_id = s.job_id""", "jobs_v", "job_sources_v")(lambda t: s.merged_collisions(t.jobs, t.job_sources)[1].select("source", "source_job_id", "job_id"))
NULLED = "CASE WHEN k % 4 = 1 THEN NULL ELSE job_fingerprint END"
query("d10_collision_without_print", f"""
WITH j AS (SELECT job_id, first_seen_at, {NULLED} AS p FROM jobs_v), t AS (SELECT job_id, CASE WHEN p IS NULL THEN job_id ELSE first_value(job_id) OVER (PARTITION BY p ORDER BY first_seen_at NULLS LAST, job_id) END AS target FROM j)
SELECT DISTINCT s.source, s.source_job_id, coalesce(t.target, s.job_id) AS job_id, (SELECT count(*) FROM t WHERE job_id = target) AS jobs FROM job_sources_v s LEFT JOIN t ON t.job_id = s.job_id""", "jobs_v", "job_sources_v")(
    # A quarter of the jobs has no fingerprint: they are no collision, and stay.
    lambda t: (lambda kept, moved: moved.select("source", "source_job_id", "job_id").crossJoin(kept.agg(F.count(F.lit(1)).alias("jobs"))))(*s.merged_collisions(t.jobs.withColumn("job_fingerprint", F.expr(NULLED)), t.job_sources))
)
query("w01_rank_without_print", f"SELECT job_id, CASE WHEN k % 4 <> 1 THEN CASE WHEN row_number() OVER (PARTITION BY {NULLED} ORDER BY last_seen_at DESC, job_id) > 1 THEN md5(concat(job_fingerprint, '|', job_id)) ELSE job_fingerprint END END AS job_fingerprint FROM jobs_v")(
    lambda t: s.ranked_fingerprints(t.jobs.withColumn("job_fingerprint", F.expr(NULLED)), AS_OF).select("job_id", "job_fingerprint")
)
query("d11_duplicates_deleted", "SELECT count(DISTINCT job_fingerprint) AS jobs FROM jobs_v")(lambda t: s.merged_collisions(t.jobs, t.job_sources)[0].agg(F.count(F.lit(1)).alias("jobs")))
query("d08_department_backfill", "SELECT job_id, CASE WHEN k % 2 = 0 THEN 'own' ELSE 'found' END AS source_department FROM jobs_v")(
    lambda t: s.filled_department(t.jobs.withColumn("source_department", F.when(F.col("k") % 2 == 0, "own")), t.jobs.select("job_id", F.lit("found").alias("department"))).select("job_id", "source_department")
)

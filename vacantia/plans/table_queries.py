"""Board, company, key and ingestion tables, audit bundles and backfills over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.functions import geo
from vacantia.functions import text as x
from vacantia.operators import audit, boards, market, search, state
from vacantia.plans import exports
from vacantia.plans.audit_queries import HEALTH, REASONS, SOURCE_STATS, SOURCE_TREND
from vacantia.plans.bindings import AS_OF, MID
from vacantia.plans.registry import query
from vacantia.sources import boards as payloads

T = f"TIMESTAMP '{AS_OF}'"


def rows(t, sql: str):
    """A text over the views, which Spark and DuckDB both run."""
    named = {v: getattr(t, n) for v, n in (("jobs_v", "jobs"), ("companies_v", "companies"), ("company_ats_v", "company_ats"), ("job_sources_v", "job_sources")) if v in sql}
    sql = sql.replace("{", "{{").replace("}", "}}")
    for v in named:
        sql = sql.replace(v, "{" + v + "}")
    return t.spark.sql(sql.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), **named)


STATUS = "CASE CAST(k % 5 AS INT) WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN NULL WHEN 3 THEN 429 ELSE 200 END"
query("s15_fetch_errors", f"SELECT job_id, CASE WHEN k % 7 = 0 THEN 'fetch_network_failed' WHEN {STATUS} = 404 THEN 'invalid_ats_slug' WHEN {STATUS} >= 400 THEN 'fetch_failed' END AS error FROM jobs_v")(
    lambda t: t.jobs.select("job_id", boards.fetch_error(F.expr(STATUS), F.col("k") % 7 == 0).alias("error"))
)

# Inserts by natural key.
KNOWN = "SELECT provider, ats_slug AS slug, 'old' AS discovery_source FROM company_ats_v WHERE company_ats_id % 3 = 0 GROUP BY provider, ats_slug"
FOUND = "SELECT provider, ats_slug AS slug, concat('by', CAST(company_ats_id % 4 AS VARCHAR(10))) AS discovery_source FROM company_ats_v"
query("k08_slugs_inserted", f"WITH o AS ({KNOWN}), n AS ({FOUND}) SELECT * FROM o UNION ALL SELECT provider, slug, min(discovery_source) AS discovery_source FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.provider = n.provider AND o.slug = n.slug) GROUP BY provider, slug", "company_ats_v")(
    lambda t: market.keep_first(rows(t, KNOWN), rows(t, FOUND), "provider", "slug")
)
query("k09_boards_inserted", "SELECT provider, ats_slug, min(company_id) AS company_id FROM company_ats_v GROUP BY 1, 2")(lambda t: market.keep_first(t.company_ats.select("provider", "ats_slug", "company_id").limit(0), t.company_ats.select("provider", "ats_slug", "company_id"), "provider", "ats_slug"))
NAMES = "SELECT CASE WHEN k % 4 = 0 THEN upper(company_name) WHEN k % 4 = 1 THEN concat(company_name, ' Ltd') WHEN k % 4 = 2 THEN '' ELSE lower(company_name) END AS name FROM jobs_v"
query("k10_placeholders", f"SELECT md5(lower(name)) AS company_id, min(name) AS legal_name, 'ZZ' AS hq_country, false AS eu_entity_verified, 'UNKNOWN' AS remote_posture, true AS is_active, true AS bootstrap FROM ({NAMES}) WHERE name <> '' AND lower(name) NOT IN (SELECT lower(legal_name) FROM companies_v) GROUP BY lower(name)", "jobs_v")(
    lambda t: boards.placeholders(rows(t, NAMES), t.companies)
)
SOME = "SELECT CAST(company_id AS VARCHAR(20)) AS company_id, legal_name, hq_country, eu_entity_verified, remote_posture, ats_provider, careers_url, is_active, (company_id % 2 = 0) AS bootstrap FROM companies_v WHERE company_id % 5 <> 0"
ENTRIES = "SELECT CASE WHEN company_id % 2 = 0 THEN upper(legal_name) ELSE legal_name END AS legal_name, 'PL' AS hq_country, true AS eu_entity_verified, 'REMOTE_ONLY' AS remote_posture, CAST(NULL AS VARCHAR(20)) AS ats_provider, 'https://x.example.com' AS careers_url FROM companies_v WHERE company_id % 5 IN (0, 1)"
query("k10_curated", f"""
WITH c AS ({SOME}), e AS ({ENTRIES})
SELECT coalesce(c.company_id, md5(lower(e.legal_name))) AS company_id, coalesce(c.legal_name, e.legal_name) AS legal_name, {", ".join(f"CASE WHEN e.legal_name IS NULL THEN c.{n} ELSE e.{n} END AS {n}" for n in boards.CURATED)},
  CASE WHEN e.legal_name IS NULL THEN c.is_active ELSE true END AS is_active, CASE WHEN e.legal_name IS NULL THEN c.bootstrap ELSE false END AS bootstrap
FROM c FULL JOIN e ON lower(c.legal_name) = lower(e.legal_name)""", "companies_v")(lambda t: boards.curated(rows(t, SOME), rows(t, ENTRIES)))
query("j20_natural_key", f"SELECT name, (SELECT min(company_id) FROM companies_v c WHERE lower(c.legal_name) = lower(n.name)) AS company_id FROM ({NAMES}) n", "jobs_v", "companies_v")(lambda t: boards.by_name(rows(t, NAMES), t.companies))
query("j12_orphans", "SELECT source, source_job_id FROM job_sources_v WHERE job_id NOT IN (SELECT job_id FROM jobs_v WHERE k % 3 = 0)", "jobs_v")(lambda t: boards.orphans(t.job_sources, t.jobs.filter("k % 3 = 0"), "job_id").select("source", "source_job_id"))
query("f23_lookup", "SELECT job_id, source, title FROM jobs_v WHERE (job_id, source) IN (SELECT job_id, source FROM job_sources_v WHERE seen_count = 2)", "job_sources_v")(lambda t: boards.lookup(t.jobs, t.job_sources.filter("seen_count = 2"), "job_id", "source").select("job_id", "source", "title"))
query("f25_ttl", "SELECT source, CASE source WHEN 'example_source' THEN 72 ELSE 48 END AS hours FROM (SELECT DISTINCT source FROM jobs_v UNION ALL SELECT 'example_source')")(
    lambda t: t.jobs.select("source").distinct().union(t.spark.sql("SELECT 'example_source'")).select("source", boards.ttl_hours(F.col("source")).alias("hours"))
)

# Discovery lists and queues.
CHECKED = f"SELECT *, CASE WHEN company_id % 3 = 0 THEN NULL ELSE {T} - INTERVAL '1' DAY END AS careers_last_checked_at, CASE WHEN company_id % 4 = 0 THEN NULL WHEN company_id % 4 = 1 THEN {T} - INTERVAL '9' DAY ELSE {T} END AS ats_guess_last_checked_at FROM companies_v"
query("f24_discovered", "SELECT c.legal_name AS company_name, a.provider, a.ats_slug, a.created_at FROM company_ats_v a JOIN companies_v c ON c.company_id = a.company_id ORDER BY a.created_at DESC, a.company_ats_id LIMIT 100")(lambda t: boards.discovered(t.company_ats, t.companies))
query("f24_candidates", f"SELECT company_id, legal_name, careers_url, careers_last_checked_at, ats_guess_last_checked_at FROM ({CHECKED}) WHERE ats_provider IS NULL AND careers_url IS NOT NULL ORDER BY careers_last_checked_at NULLS FIRST, ats_guess_last_checked_at NULLS FIRST, company_id LIMIT 50", "companies_v")(lambda t: boards.candidates(rows(t, CHECKED)))
for phase, column in boards.PHASES.items():
    query(f"p03_queue_{phase}", f"SELECT company_id, legal_name, careers_url FROM ({CHECKED}) WHERE is_active AND ats_provider IS NULL AND careers_url IS NOT NULL ORDER BY {column} NULLS FIRST, company_id LIMIT 40", "companies_v")(lambda t, p=phase: boards.phase_queue(rows(t, CHECKED), p, 40))
query("t04_sync_queue", "SELECT company_ats_id, provider, last_sync_at FROM company_ats_v WHERE is_active ORDER BY last_sync_at NULLS FIRST, company_ats_id LIMIT 30")(lambda t: t.company_ats.filter("is_active").orderBy(F.asc_nulls_first("last_sync_at"), "company_ats_id").limit(30).select("company_ats_id", "provider", "last_sync_at"))
SLUGS = "SELECT k AS id, source AS provider, concat('slug-', job_id) AS slug, CASE WHEN k % 3 = 0 THEN 'pending' WHEN k % 3 = 1 THEN 'promoted' ELSE 'rejected' END AS status, first_seen_at AS created_at FROM jobs_v"
query("t13_pending", f"SELECT id, provider, slug FROM ({SLUGS}) WHERE status = 'pending' ORDER BY created_at, id LIMIT 200", "jobs_v")(lambda t: boards.pending(rows(t, SLUGS)))
query("f24_slugs", f"SELECT * FROM ({SLUGS}) WHERE provider = 'src2' AND status = 'promoted' ORDER BY created_at DESC, id LIMIT 100", "jobs_v")(lambda t: boards.slugs(rows(t, SLUGS), "src2", "promoted"))

# Sync bookkeeping and keys.
ATS = f"SELECT company_ats_id, last_sync_at, created_at AS updated_at, is_active FROM company_ats_v"
query("d12_synced", f"SELECT company_ats_id, CASE WHEN company_ats_id % 3 = 0 THEN {T} ELSE last_sync_at END AS last_sync_at, CASE WHEN company_ats_id % 3 < 2 THEN {T} ELSE updated_at END AS updated_at, is_active AND company_ats_id % 8 <> 0 AS is_active FROM ({ATS})", "company_ats_v")(
    lambda t: boards.deactivated(boards.synced(rows(t, ATS), t.company_ats.filter("company_ats_id % 3 < 2").select("company_ats_id", F.explode(F.array(F.lit(True), F.col("company_ats_id") % 3 == 0)).alias("success")), AS_OF), t.company_ats.filter("company_ats_id % 8 = 0"))
)
ASKED = "SELECT concat('id', CAST(company_id AS VARCHAR(20))) AS key_id, concat('raw', CAST(company_id AS VARCHAR(20))) AS raw_key, legal_name AS label, CASE CAST(company_id % 3 AS INT) WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'enterprise' END AS tier FROM companies_v"
QUOTA = "CASE tier WHEN 'free' THEN 500 WHEN 'pro' THEN 10000 ELSE -1 END"
query("h07_key_hash", f"SELECT key_id, sha256(raw_key) AS key_hash FROM ({ASKED})", "companies_v")(lambda t: boards.new_keys(rows(t, ASKED), AS_OF).select("key_id", "key_hash"))
query("k18_keys", f"SELECT key_id, label, tier, {QUOTA} AS quota_per_day, 0 AS requests_today, CAST({T} AS DATE) AS quota_reset_date, key_id <> 'id7' AS is_active, {T} AS created_at FROM ({ASKED})", "companies_v")(lambda t: boards.listed_keys(boards.revoked(boards.new_keys(rows(t, ASKED), AS_OF), ["id7"])))
KEYS = "SELECT CAST(company_id AS VARCHAR(20)) AS key_id, CASE WHEN company_id % 4 = 0 THEN -1 ELSE 9 END AS quota_per_day, 3 AS requests_today, CASE WHEN company_id % 5 = 0 THEN NULL WHEN company_id % 2 = 0 THEN CAST('2001-08-01' AS DATE) ELSE CAST('2001-08-02' AS DATE) END AS quota_reset_date FROM companies_v"
CALLS = "SELECT CAST(company_id AS VARCHAR(20)) AS key_id FROM jobs_v"
query("d09_quota_counter", f"""
WITH k AS ({KEYS}), n AS (SELECT key_id, count(*) AS n FROM ({CALLS}) GROUP BY 1),
u AS (SELECT k.key_id, quota_per_day, n.n, CASE WHEN n.n IS NULL THEN requests_today ELSE n.n + CASE WHEN quota_reset_date IS NULL OR quota_reset_date < DATE '2001-08-02' THEN 0 ELSE requests_today END END AS requests_today, CASE WHEN n.n IS NULL THEN quota_reset_date ELSE DATE '2001-08-02' END AS quota_reset_date FROM k LEFT JOIN n ON n.key_id = k.key_id)
SELECT key_id, quota_per_day, CAST(requests_today AS BIGINT) AS requests_today, quota_reset_date, CAST(CASE WHEN quota_per_day < 0 OR n IS NULL THEN 0 ELSE greatest(0, least(n, requests_today - quota_per_day)) END AS BIGINT) AS refused FROM u""", "companies_v", "jobs_v")(
    lambda t: boards.counted_calls(rows(t, KEYS), rows(t, CALLS), "2001-08-02")
)

# Audit bundles, pages, counters and shares.
PARTS = {"source_trend": SOURCE_TREND, "rejection_reasons": REASONS.format(30), "source_7d": SOURCE_STATS, "ats_health": HEALTH.format("")}
query("k15_audit_parts", "SELECT 'metrics' AS part, 1 AS n UNION ALL " + " UNION ALL ".join(f"SELECT '{p}', count(*) FROM ({sql})" for p, sql in PARTS.items()) + " UNION ALL SELECT 'company_stats', count(*) FROM (SELECT c.legal_name FROM jobs_v j JOIN companies_v c ON c.company_id = j.company_id GROUP BY 1 HAVING count(*) > 5)")(
    lambda t: exports.part_sizes(exports.audit_parts(t.jobs, t.job_sources, t.companies, t.company_ats, t.compliance_reports, AS_OF))
)
query("k15_audit_snapshot")(lambda t: exports.audit_json(exports.audit_parts(t.jobs, t.job_sources, t.companies, t.company_ats, t.compliance_reports, AS_OF), AS_OF))
query("f19_without_empty", f"SELECT * FROM ({SOURCE_STATS.replace('INTERVAL 7 DAY', 'INTERVAL 30 DAY')}) WHERE approved > 0")(lambda t: audit.without_empty(audit.source_stats(t.jobs, t.job_sources, AS_OF, 30)))
query("a18_page_total", "SELECT job_id, (SELECT count(*) FROM jobs_v WHERE status = 'active') AS total FROM jobs_v WHERE status = 'active' ORDER BY first_seen_at DESC NULLS FIRST, job_id LIMIT 20 OFFSET 40")(
    lambda t: (lambda found: search.with_total(found, search.page(found, 20, 40)).select("job_id", "total"))(search.search(t.jobs, status="active"))
)
DONE = "SELECT source, remote_class, CASE WHEN k % 4 = 0 THEN 'geo_restriction_hard' WHEN k % 4 = 1 THEN 'non_remote' WHEN k % 4 = 2 THEN 'other' END AS policy_reason, compliance_status = 'approved' AS accepted, salary_min_eur IS NOT NULL AS has_salary, k FROM jobs_v"
query("a20_counters", f"""
SELECT source, count(*) AS fetched, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS skipped, count(*) FILTER (policy_reason IN ('geo_restriction_hard', 'non_remote')) AS rejected_policy_count, count(*) FILTER (policy_reason = 'geo_restriction_hard') AS hard_geo_rejected_count,
  count(*) FILTER (remote_class = 'remote_only') AS model_remote_only, count(*) FILTER (remote_class = 'remote_region_locked') AS model_geo_restricted, CAST(0 AS BIGINT) AS model_non_remote, count(*) FILTER (remote_class IS NULL OR remote_class NOT IN ('remote_only', 'remote_region_locked')) AS model_unknown,
  count(*) FILTER (has_salary) AS salary_detected, count(*) FILTER (NOT has_salary) AS salary_missing
FROM ({DONE}) GROUP BY source""", "jobs_v")(
    lambda t: (lambda done: boards.merged_counters(boards.ingestion_counters(done.filter("k % 2 = 0"), "source").union(boards.ingestion_counters(done.filter("k % 2 = 1"), "source")), "source"))(rows(t, DONE))
)
query("a25_leftover_rows", r"""
WITH g AS (SELECT page_id, unnest(t) AS tag, unnest(range(len(t))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<[^>]+>') AS t FROM pages WHERE html LIKE '%<%>%')),
c AS (SELECT page_id, tag, count(*) AS n, min(pos) AS pos FROM g GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, pos) AS p FROM c)
SELECT page_id, CAST(sum(n) AS BIGINT) AS tag_count, string_agg(CASE WHEN p <= 5 THEN tag || ': ' || n END, ', ' ORDER BY p) AS top_tags FROM r GROUP BY page_id ORDER BY tag_count DESC, page_id LIMIT 50""")(lambda t: audit.leftover_rows(t.read("pages"), "page_id", "html"))
query("a26_class_shares", "SELECT coalesce(remote_class, 'none') AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 1) AS pct FROM jobs_v GROUP BY 1")(lambda t: boards.class_shares(t.jobs, "remote_class"))
query("a26_recommendation", "SELECT source, CASE WHEN r > 30 AND e > 10 THEN 'STRONG' WHEN r > 20 THEN 'CONDITIONAL' ELSE 'WEAK' END AS candidate FROM (SELECT source, count(*) FILTER (remote_class IN ('remote_only', 'remote_optional')) * 100e0 / count(*) AS r, count(*) FILTER (geo_class = 'eu_explicit') * 100e0 / count(*) AS e FROM jobs_v GROUP BY 1)")(
    lambda t: (lambda share: t.jobs.groupBy("source").agg(boards.recommendation(share(F.col("remote_class").isin("remote_only", "remote_optional")), share(F.col("geo_class") == "eu_explicit")).alias("candidate")))(lambda c: F.count_if(c) * 100.0 / F.count(F.lit(1)))
)
query("c16_eu_scope", "SELECT job_id, CASE WHEN s LIKE '%us only%' THEN 'EU_INCOMPATIBLE' WHEN s LIKE '%eu%' THEN 'EU_EXPLICIT' WHEN s LIKE '%worldwide%' THEN 'EU_COMPATIBLE' ELSE 'EU_UNKNOWN' END AS scope_class FROM (SELECT job_id, lower(CASE WHEN k % 5 = 0 THEN 'US only' WHEN k % 5 = 1 THEN 'Worldwide' WHEN k % 5 = 2 THEN 'Europe' ELSE coalesce(remote_scope, '') END) AS s FROM jobs_v)")(
    lambda t: t.jobs.select("job_id", boards.eu_scope(F.when(F.col("k") % 5 == 0, "US only").when(F.col("k") % 5 == 1, "Worldwide").when(F.col("k") % 5 == 2, "Europe").otherwise(F.col("remote_scope"))).alias("scope_class"))
)
SERIES = "SELECT CAST(first_seen_at AS DATE) AS date, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE avg(salary_min_eur) END AS v FROM jobs_v GROUP BY 1"
query("m05_zero", f"SELECT date, coalesce(v, 0) AS v FROM ({SERIES})", "jobs_v", rounded=("v",))(lambda t: market.filled_with_zero(rows(t, SERIES), "v"))
query("d6_axis_labels", f"""
WITH d AS (SELECT DISTINCT CAST(first_seen_at AS DATE) AS day FROM jobs_v), p AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS place, count(*) OVER () AS n FROM d)
SELECT CAST(place AS INTEGER) AS place, strftime(day, '%b %d') AS label FROM p WHERE n <= 6 OR place IN (SELECT CAST(round_even(i * (n - 1) / 5e0, 0) AS BIGINT) FROM range(6) r(i))""", "jobs_v")(lambda t: market.axis_labels(t.jobs.select(F.to_date("first_seen_at").alias("date"))))

# Text, identity, versions.
LATE = r"regexp_replace(regexp_replace(lower(coalesce({0}, '')), '^[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}]+|[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}]+$', '', 'g'), '[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}]+', ' ', 'g')"
query("x01b_normalise_late", f"SELECT doc_id, md5({LATE.format('text')}) AS text_md5 FROM documents")(lambda t: t.read("documents").select("doc_id", F.md5(x.normalise_late(F.col("text")).cast("binary")).alias("text_md5")))
PLAIN = r"lower(regexp_replace(coalesce({0}, ''), '[\s\x0B]+', ' ', 'g'))"
query("h05_stored_fingerprint", f"SELECT doc_id, md5(concat_ws('|', CAST(doc_id AS VARCHAR), {PLAIN.format('source')}, {PLAIN.format('lang')}, '', substr({PLAIN.format('text')}, 1, 500))) AS job_fingerprint FROM documents")(
    lambda t: t.read("documents").select("doc_id", x.stored_fingerprint(F.col("doc_id"), F.col("source"), F.col("lang"), F.lit(None), F.col("text")).alias("job_fingerprint"))
)
query("h06_policy_version")(lambda t: t.spark.range(1).select(F.lit(geo.policy_version()).alias("policy_version")))
query("p05_without_tags", "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS text_md5 FROM pages")(lambda t: t.read("pages").select("page_id", F.md5(x.without_tags(F.col("html")).cast("binary")).alias("text_md5")))
query("n04_scoring_step", "SELECT job_id, CASE WHEN k % 3 > 0 THEN CAST(compliance_score AS VARCHAR) END AS score FROM jobs_v")(
    lambda t: t.jobs.select("job_id", geo.scoring_step(F.filter(F.array(*[F.struct(F.lit(s).alias("step"), F.col("compliance_score").cast("string").alias("score"), F.lit(k).alias("w")) for s, k in (("remote_classifier", 0), ("scoring", 1), ("resolver", 0))]), lambda s: (s["w"] == 0) | (F.col("k") % 3 > 0)))["score"].alias("score"))
)

# Batches with repeated keys, three lookups, changed-only forms, backfills, cursors.
BATCH = "SELECT CAST(company_id AS VARCHAR(20)) AS job_id, CASE WHEN k % 3 = 0 THEN NULL ELSE source END AS source, title, first_seen_at, status, k FROM jobs_v"
query("d01_batch_collapse", f"SELECT job_id, arg_min(source, k) FILTER (source IS NOT NULL) AS source, arg_max(title, k) AS title, min(first_seen_at) AS first_seen_at, arg_max(status, k) AS status FROM ({BATCH}) GROUP BY job_id", "jobs_v")(
    lambda t: (lambda b: state.merged_jobs(b.drop("k").limit(0), b, order=F.col("k")))(rows(t, BATCH))
)
STORED = "SELECT job_id, job_fingerprint, source, concat(job_id, '-1') AS source_job_id FROM jobs_v WHERE k % 2 = 0"
COMES = "SELECT k AS position, concat('in', job_id) AS job_id, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN job_fingerprint ELSE concat(job_fingerprint, '#', CAST(k AS VARCHAR(20))) END AS job_fingerprint, source, concat(job_id, '-1') AS source_job_id FROM jobs_v WHERE k % 3 <> 0"
query("j16_three_lookups", f"""
WITH s AS ({STORED}), m AS (SELECT source, source_job_id, min(job_id) AS b FROM job_sources_v WHERE seen_count = 1 GROUP BY ALL), i AS ({COMES}),
p AS (SELECT job_fingerprint, min(job_id) AS f FROM s GROUP BY 1), q AS (SELECT source, source_job_id, min(job_id) AS c FROM s GROUP BY ALL),
r AS (SELECT i.*, coalesce(p.f, m.b, q.c, i.job_id) AS id FROM i LEFT JOIN p ON p.job_fingerprint = i.job_fingerprint LEFT JOIN m ON m.source = i.source AND m.source_job_id = i.source_job_id LEFT JOIN q ON q.source = i.source AND q.source_job_id = i.source_job_id)
SELECT position, job_id, job_fingerprint, CASE WHEN job_fingerprint IS NULL THEN id ELSE first_value(id) OVER (PARTITION BY job_fingerprint ORDER BY position) END AS canonical_id FROM r""", "jobs_v", "job_sources_v")(
    lambda t: state.canonical_ids(rows(t, COMES), rows(t, STORED), t.job_sources.filter("seen_count = 1"))
)
query("a17_changed_reposts", f"""
WITH c AS (SELECT j.job_id, j.is_repost AS was, j.repost_count AS had, count(p.job_id) AS n FROM jobs_v j LEFT JOIN jobs_v p ON j.job_fingerprint = p.job_fingerprint AND j.company_name = p.company_name AND j.title = p.title AND j.job_id <> p.job_id
  AND j.first_seen_at > p.last_seen_at AND j.first_seen_at - p.last_seen_at < INTERVAL 900 DAY WHERE j.first_seen_at > {T} - INTERVAL 915 DAY GROUP BY ALL)
SELECT job_id, n > 0 AS is_repost, n AS repost_count FROM c WHERE (n > 0) IS DISTINCT FROM was OR n IS DISTINCT FROM had""", "jobs_v")(lambda t: state.changed_reposts(t.jobs, AS_OF, 900).select("job_id", "is_repost", "repost_count"))
query("w02_changed_fingerprints", "SELECT job_id, md5(concat(job_fingerprint, '|', job_id)) AS job_fingerprint FROM jobs_v QUALIFY row_number() OVER (PARTITION BY job_fingerprint ORDER BY last_seen_at DESC, job_id) > 1")(lambda t: state.changed_fingerprints(t.jobs, AS_OF).select("job_id", "job_fingerprint"))
query("d14_resolution_update", "SELECT job_id, CASE WHEN k % 4 = 0 THEN 'review' ELSE compliance_status END AS compliance_status, CASE WHEN k % 4 = 0 THEN 7 ELSE compliance_score END AS compliance_score FROM jobs_v")(
    lambda t: state.resolved(t.jobs, t.jobs.filter("k % 4 = 0").select("job_id", F.lit("review").alias("compliance_status"), F.lit(7).alias("compliance_score"))).select("job_id", "compliance_status", "compliance_score")
)
TOLD = "SELECT job_id, 'Engineer' AS title, CASE WHEN k % 3 = 0 THEN 'US only' ELSE '' END AS description, 'Remote - Poland' AS remote_scope, CAST(NULL AS VARCHAR(20)) AS remote_class, CAST(NULL AS VARCHAR(20)) AS geo_class, compliance_status, compliance_score, CASE WHEN k % 2 = 0 THEN 'v9' ELSE policy_version END AS policy_version FROM jobs_v"
FRESH = "(compliance_status IS NOT NULL AND compliance_score IS NOT NULL AND coalesce(policy_version = 'v9', false))"
query("d08_compliance_backfill", f"SELECT job_id, CASE WHEN {FRESH} THEN NULL WHEN description = '' THEN 'remote_region_locked' ELSE 'unknown' END AS remote_class, CASE WHEN {FRESH} THEN compliance_status WHEN description = '' THEN 'approved' ELSE 'rejected' END AS compliance_status, CASE WHEN {FRESH} THEN compliance_score WHEN description = '' THEN 90 ELSE 0 END AS compliance_score, 'v9' AS policy_version FROM ({TOLD})", "jobs_v")(
    lambda t: state.filled_compliance(rows(t, TOLD), "v9").select("job_id", "remote_class", "compliance_status", "compliance_score", "policy_version")
)
PAID = "SELECT job_id, title, CASE WHEN k % 3 = 0 THEN 'Salary: €80k–€100k per year' ELSE 'no word of it' END AS description, CASE WHEN k % 4 = 0 THEN 5 END AS salary_min, CAST(NULL AS INT) AS salary_max, CAST(NULL AS VARCHAR(20)) AS salary_currency, k FROM jobs_v"
query("d08_salary_backfill", f"SELECT job_id, CASE WHEN k % 4 = 0 THEN 5 WHEN k % 3 = 0 THEN 80000 END AS salary_min, CASE WHEN k % 4 <> 0 AND k % 3 = 0 THEN 100000 END AS salary_max, CASE WHEN k % 4 <> 0 AND k % 3 = 0 THEN 'EUR' END AS salary_currency FROM ({PAID})", "jobs_v")(
    lambda t: state.filled_salary(rows(t, PAID)).select("job_id", "salary_min", "salary_max", "salary_currency")
)
RAW = "SELECT job_id, CASE WHEN k % 5 = 0 THEN 'soon' WHEN k % 5 = 1 THEN NULL ELSE concat(CAST(CAST(first_seen_at AS DATE) AS VARCHAR(20)), 'T00:00:00Z') END AS updated_at, CASE WHEN k % 10 = 0 THEN '2000-01-01' END AS published_at, first_seen_at, k FROM jobs_v"
query("f17_incremental", f"SELECT job_id FROM ({RAW}) WHERE CASE WHEN k % 10 = 0 THEN TIMESTAMP '2000-01-01' >= TIMESTAMP '{MID}' WHEN k % 5 IN (0, 1) THEN true ELSE first_seen_at >= TIMESTAMP '{MID}' END", "jobs_v")(lambda t: payloads.updated_since(rows(t, RAW), MID, "updated_at", "published_at").select("job_id"))

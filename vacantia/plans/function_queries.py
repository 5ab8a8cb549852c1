"""Rules called as SQL functions of a session, over whole tables."""

from __future__ import annotations

from vacantia.functions import classify, session
from vacantia.plans.posted_queries import NAMED
from vacantia.plans.registry import ORACLES, query
from vacantia.plans.rule_queries import POSTINGS, parts, words
from vacantia.plans.table_queries import rows
from vacantia.plans.text_queries import NORM

START = "substr({0}, 1, {1})"


def stripped(column: str) -> str:
    return rf"regexp_replace({column}, '^[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}]+|[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}]+$', '', 'g')"


def start(cut: int, kept: int) -> str:
    return START.format(NORM.format(START.format(stripped("text"), cut)), kept)


query("udf_text", f"""
SELECT doc_id, md5({NORM.format('text')}) AS text_md5, sha256(concat_ws('|', CAST(doc_id AS VARCHAR), {NORM.format('source')}, {NORM.format('lang')})) AS job_uid,
  md5(concat_ws('|', CAST(doc_id AS VARCHAR), {NORM.format('source')}, {NORM.format('lang')}, '', {start(1500, 500)})) AS job_fingerprint,
  sha1(concat_ws('|', {NORM.format('source')}, {NORM.format('lang')}, {start(3000, 1000)})) AS canonical_id FROM documents""")(
    lambda t: session.register(t.spark).sql("""
SELECT doc_id, md5(normalised_text(text)) AS text_md5, job_uid(doc_id, source, lang) AS job_uid, job_fingerprint(doc_id, source, lang, NULL, text) AS job_fingerprint, canonical_job_id(source, lang, text) AS canonical_id
FROM {docs}""", docs=t.read("documents"))
)
ELIGIBLE = "lower(geo_class) IN ('eu_member_state', 'eu_explicit', 'eu_region', 'uk')"
RULED = f"SELECT p.*, j.remote_class, j.geo_class, j.salary_min_eur FROM ({POSTINGS}) p JOIN jobs_v j ON j.job_id = p.job_id"
query("udf_rules", f"""
SELECT job_id, {words("lower(coalesce(description, ''))", classify.HARD)} AS hard_geo,
  CASE WHEN lower(remote_class) = 'non_remote' OR lower(geo_class) = 'non_eu' THEN 0 WHEN {ELIGIBLE} THEN CASE remote_class WHEN 'remote_only' THEN 100 WHEN 'remote_region_locked' THEN 90 WHEN 'remote_optional' THEN 60 ELSE 55 END ELSE 20 END AS score,
  CASE WHEN lower(remote_class) = 'non_remote' OR lower(geo_class) = 'non_eu' THEN 'rejected' WHEN {ELIGIBLE} THEN CASE WHEN remote_class IN ('remote_only', 'remote_region_locked') THEN 'approved' ELSE 'review' END ELSE 'rejected' END AS status,
  CASE WHEN k % 3 = 0 THEN 'USD' WHEN k % 3 = 1 THEN 'PLN' END AS currency, salary_min_eur * CASE WHEN k % 3 = 0 THEN 0.92e0 WHEN k % 3 = 1 THEN 0.23e0 END AS eur,
  CASE WHEN k % 2 = 0 THEN 'disclosed' WHEN coalesce(description, '') = '' THEN 'unknown' WHEN {parts('lower(description)', classify.TRANSPARENCY)} THEN 'transparent_statement' ELSE 'not_disclosed' END AS transparency
FROM ({RULED})""", "jobs_v", rounded=("eur",))(
    lambda t: session.register(t.spark).sql("""
SELECT job_id, is_hard_geo(description) AS hard_geo, compliance_score(remote_class, geo_class) AS score, compliance_status(remote_class, geo_class) AS status, text_currency(pay) AS currency,
  in_euros(salary_min_eur, text_currency(pay)) AS eur, salary_transparency(description, k % 2 = 0) AS transparency
FROM (SELECT *, CASE WHEN k % 3 = 0 THEN '$100' WHEN k % 3 = 1 THEN '100 Zloty' ELSE 'nothing' END AS pay FROM {jobs})""", jobs=rows(t, RULED))
)
ORACLES["udf_taxonomy"] = ORACLES["c09_taxonomy_rows"]
query("udf_taxonomy")(
    lambda t: session.register(t.spark).sql("SELECT job_id, job_family(title, department) AS job_family, job_role(title, department) AS job_role, job_seniority(title) AS seniority, job_specialization(title) AS specialization FROM {jobs}", jobs=rows(t, POSTINGS))
)
ORACLES["udtf_slug_guesses"] = ORACLES["s23_guess_rows"]
query("udtf_slug_guesses")(
    lambda t: session.register(t.spark).sql("SELECT company_id, array_join(transform(array_sort(collect_list(struct(g.place, g.slug))), x -> x.slug), ',') AS guesses FROM {names} n, LATERAL slug_guesses(n.name) g GROUP BY company_id", names=rows(t, NAMED))
)

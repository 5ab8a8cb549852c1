"""Search, pages, feed filters and company lists over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.operators import search as s
from vacantia.operators import trigram_index
from vacantia.plans.registry import query
from vacantia.streaming.tick import shared_folder

COLS = ("job_id", "title", "company_name", "status", "compliance_score", "first_seen_at")
NAMES = ", ".join(COLS)
#: Distinct trigrams of a text's words, as SQL that DuckDB runs.
GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def distance(a: str, b: str) -> str:
    x, y = GRAMS.format(a), GRAMS.format(b)
    return f"1 - CAST(len(list_intersect({x}, {y})) AS DOUBLE) / nullif(len(list_distinct(list_concat({x}, {y}))), 0)"


query("f01_search", f"SELECT {NAMES} FROM jobs_v WHERE status IN ('new', 'active') AND title ILIKE '%urgent%' AND compliance_score >= 80")(lambda t: s.search(t.jobs, status="visible", title="urgent", min_compliance_score=80).select(*COLS))
query("f04_score_threshold", f"SELECT {NAMES} FROM jobs_v WHERE coalesce(compliance_score, 0) >= 0 AND status = 'stale'")(lambda t: s.search(t.jobs, status="stale", min_compliance_score=0).select(*COLS))
query("f05_audit_filter", f"""
SELECT {NAMES} FROM jobs_v j WHERE remote_scope ILIKE '%spain%' AND geo_class = 'eu_region' AND coalesce(compliance_score, 0) >= 0 AND coalesce(compliance_score, 0) <= 95
 AND EXISTS (SELECT 1 FROM job_sources_v x WHERE x.job_id = j.job_id AND x.source = 'src2')""")(
    lambda t: s.search(t.jobs, t.job_sources, source="src2", audit=True, remote_scope="spain", geo_class="eu_region", min_compliance_score=0, max_compliance_score=95).select(*COLS)
)
query("f06_paid_filter", f"""
SELECT {NAMES} FROM jobs_v WHERE status IN ('new', 'active') AND remote_class = 'remote_only' AND job_family = '1-URGENT' AND specialization = 'backend'
 AND (title ILIKE '%build%' OR company_name ILIKE '%build%') AND first_seen_at >= TIMESTAMP '1995-01-01' AND first_seen_at < TIMESTAMP '1999-12-31' + INTERVAL 1 DAY""")(
    lambda t: s.search(t.jobs, status="visible", remote_class="remote_only", job_family="1-URGENT", specialization="backend", q="build", first_seen_after="1995-01-01", first_seen_before="1999-12-31").select(*COLS)
)
query("f07_date_range", f"SELECT {NAMES} FROM jobs_v WHERE first_seen_at >= TIMESTAMP '1997-03-01' AND first_seen_at < TIMESTAMP '1997-03-15' + INTERVAL 1 DAY")(lambda t: s.search(t.jobs, first_seen_after="1997-03-01", first_seen_before="1997-03-15").select(*COLS))
query("f08_companies", "SELECT company_id, legal_name, signal_score FROM companies_v WHERE ats_provider = 'greenhouse' AND is_active AND signal_score >= 50")(lambda t: s.companies(t.companies, ats_provider="greenhouse", is_active=True, min_score=50).select("company_id", "legal_name", "signal_score"))
query("f18_feed_filter", f"""
SELECT {NAMES} FROM jobs_v WHERE contains(lower(concat_ws(' ', title, company_name, remote_scope, job_family)), 'spain') AND job_family IN ('1-URGENT', '2-HIGH')
 AND CASE WHEN coalesce(nullif(salary_min_eur, 0), nullif(salary_max_eur, 0)) IS NULL THEN true
     ELSE coalesce(nullif(salary_max_eur, 0), nullif(salary_min_eur, 0)) >= 40000 AND coalesce(nullif(salary_min_eur, 0), nullif(salary_max_eur, 0)) <= 60000 END""")(
    lambda t: s.feed_filter(t.jobs, search="spain", families=["1-URGENT", "2-HIGH"], salary_min=40000, salary_max=60000).select(*COLS)
)
query("j01_semi_source", f"SELECT {NAMES} FROM jobs_v j WHERE EXISTS (SELECT 1 FROM job_sources_v x WHERE x.job_id = j.job_id AND x.source = 'src1')")(lambda t: s.search(t.jobs, t.job_sources, source="src1").select(*COLS))
query("p01_audit_page", f"SELECT {NAMES} FROM jobs_v ORDER BY coalesce(last_seen_at, TIMESTAMP '1970-01-01') DESC, job_id LIMIT 50 OFFSET 100")(lambda t: s.audit_page(t.jobs, 50, 100).select(*COLS))
query("t01_page", f"SELECT {NAMES} FROM jobs_v WHERE status = 'active' ORDER BY first_seen_at DESC NULLS FIRST, job_id LIMIT 100 OFFSET 200")(lambda t: s.page(s.search(t.jobs, status="active"), 100, 200).select(*COLS))
query("t02_trigram_search", f"""
SELECT {NAMES} FROM jobs_v WHERE title ILIKE '%automobile%' OR company_name ILIKE '%automobile%'
ORDER BY least({distance('title', "'automobile'")}, {distance('company_name', "'automobile'")}) NULLS LAST, first_seen_at DESC, job_id LIMIT 100""")(lambda t: s.page(s.search(t.jobs, q="automobile"), 100, q="automobile").select(*COLS))


def by_index(t, q: str):
    """The same page by an index of trigrams, written once for the table."""
    path = f"{shared_folder(t.spark, 'trigrams')}/jobs"
    trigram_index.write(t.jobs, path, "job_id", "title", "company_name")
    return trigram_index.page(s.search(t.jobs, status="active"), t.spark.read.parquet(path), q, 100, 20).select(*COLS)


query("t02_indexed_search", f"""
SELECT {NAMES} FROM jobs_v WHERE status = 'active'
ORDER BY least({distance('title', "'urgent mobile 00012'")}, {distance('company_name', "'urgent mobile 00012'")}) NULLS LAST, first_seen_at DESC, job_id LIMIT 100 OFFSET 20""")(lambda t: by_index(t, "urgent mobile 00012"))
query("t02_trigram_companies", f"SELECT company_id, legal_name FROM companies_v WHERE is_active AND legal_name ILIKE '%12%' ORDER BY {distance('legal_name', "'12'")}, signal_score DESC, company_id LIMIT 40")(
    lambda t: s.rank_companies(s.companies(t.companies, is_active=True, q="12"), 40, "12").select("company_id", "legal_name")
)
query("t06_company_order", "SELECT company_id, legal_name, signal_score FROM companies_v WHERE is_active ORDER BY signal_score DESC, company_id LIMIT 40")(lambda t: s.rank_companies(s.companies(t.companies, is_active=True), 40).select("company_id", "legal_name", "signal_score"))
SORTS = {
    "newest": "first_seen_at DESC",
    "oldest": "first_seen_at",
    "salary-desc": "coalesce(nullif(salary_max_eur, 0), nullif(salary_min_eur, 0), 0) DESC",
    "salary-asc": "coalesce(nullif(salary_min_eur, 0), nullif(salary_max_eur, 0)) NULLS LAST",
}
for _name, _order in SORTS.items():
    query(f"t09_feed_{_name.replace('-', '_')}", f"SELECT {NAMES} FROM jobs_v ORDER BY {_order}, job_id LIMIT 200")(lambda t, n=_name: s.feed_page(t.jobs, n).select(*COLS))
query("v07_companies", "SELECT company_id, legal_name, hq_country, remote_posture, signal_score, is_active FROM companies_v ORDER BY signal_score DESC NULLS LAST, company_id LIMIT 10000")(
    lambda t: t.companies.select("company_id", "legal_name", "hq_country", "remote_posture", "signal_score", "is_active").orderBy(F.desc_nulls_last("signal_score"), "company_id").limit(10_000)
)
query("v08_jobs", f"SELECT {NAMES} FROM (SELECT * FROM jobs_v ORDER BY last_seen_at DESC NULLS LAST, first_seen_at DESC NULLS LAST, job_id LIMIT 25000)")(
    lambda t: t.jobs.orderBy(F.desc_nulls_last("last_seen_at"), F.desc_nulls_last("first_seen_at"), "job_id").limit(25_000).select(*COLS)
)
query("u03_distinct", "SELECT DISTINCT lower(title) AS title FROM jobs_v")(lambda t: t.jobs.select(F.lower("title").alias("title")).distinct())
query("u04_difference", "SELECT legal_name FROM companies_v EXCEPT SELECT company_name FROM jobs_v")(lambda t: t.companies.select("legal_name").join(t.jobs.select(F.col("company_name").alias("legal_name")), "legal_name", "left_anti").distinct())

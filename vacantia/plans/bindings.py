"""The canonical job-market tables, bound to the star-schema test tables.

Each view is one SQL text that Spark and DuckDB both run, so a query over views has an oracle on the
same tables. On a cluster the same operators run over the real tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: The moment that stands for "now" in the registered queries, and one in the middle of the data.
AS_OF = "2001-08-02 00:00:00"
MID = "1998-06-01 00:00:00"

VIEWS = {
    "job_sources_v": """
  SELECT concat('src', CAST(l_suppkey % 7 AS VARCHAR(10))) AS source,
         concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(10))) AS source_job_id,
         CAST(l_orderkey AS VARCHAR(20)) AS job_id,
         least(o_orderdate, l_shipdate) AS first_seen_at, greatest(o_orderdate, l_shipdate) AS last_seen_at,
         CAST(l_linenumber AS INT) AS seen_count
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "jobs_v": """
  SELECT CAST(o_orderkey AS VARCHAR(20)) AS job_id, o_orderkey AS k, o_custkey AS company_id, c_name AS company_name,
         concat(o_orderpriority, ' ', c_mktsegment) AS title,
         concat(CAST(o_custkey AS VARCHAR(20)), '|', o_orderpriority) AS job_fingerprint,
         concat('src', CAST(o_orderkey % 7 AS VARCHAR(10))) AS source,
         o_orderdate AS first_seen_at, o_orderdate + INTERVAL '20' DAY AS last_seen_at,
         CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate + INTERVAL '15' DAY END AS last_verified_at,
         CAST(o_orderkey % 5 AS INT) AS verification_failures,
         CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'review' ELSE CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'rejected' END END AS compliance_status,
         CAST(CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 100 ELSE 90 END WHEN 'O' THEN 60 ELSE CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 20 END END AS INT) AS compliance_score,
         CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'remote_only' WHEN 1 THEN 'remote_region_locked' WHEN 2 THEN 'remote_optional' WHEN 3 THEN 'NON_REMOTE' END AS remote_class,
         CASE CAST(c_nationkey % 6 AS INT) WHEN 0 THEN 'eu_member_state' WHEN 1 THEN 'eu_explicit' WHEN 2 THEN 'eu_region' WHEN 3 THEN 'uk' WHEN 4 THEN 'NON_EU' END AS geo_class,
         CASE CAST(o_orderkey % 9 AS INT) WHEN 0 THEN 'Remote - Spain' WHEN 1 THEN 'Spain (Remote)' WHEN 2 THEN 'Spain' WHEN 3 THEN 'Republic of Ireland' WHEN 4 THEN 'LATAM' WHEN 5 THEN 'home based - Poland' WHEN 6 THEN 'Remote Job, Poland' WHEN 7 THEN 'EMEA' END AS remote_scope,
         CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'active' WHEN 1 THEN 'active' WHEN 2 THEN 'expired' END AS availability_status,
         CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 'new' WHEN 1 THEN 'stale' WHEN 2 THEN 'expired' ELSE 'active' END AS status,
         (o_orderkey % 3 <> 0) AS remote_source_flag, (o_orderkey % 13 = 0) AS is_repost, CAST(o_orderkey % 3 AS INT) AS repost_count,
         CASE WHEN o_orderkey % 2 = 0 THEN 'disclosed' ELSE 'not_disclosed' END AS salary_transparency_status,
         o_orderpriority AS job_family, c_mktsegment AS seniority, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'backend' END AS specialization,
         CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice / 3 END AS salary_min_eur,
         CASE WHEN o_orderkey % 10 < 3 THEN NULL ELSE o_totalprice / 2 END AS salary_max_eur,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE concat('v', CAST(o_orderkey % 3 AS VARCHAR(10))) END AS policy_version,
         CAST(o_orderkey % 101 AS INT) AS job_quality_score
  FROM orders JOIN customer ON c_custkey = o_custkey""",
    "companies_v": """
  SELECT c_custkey AS company_id, c_name AS legal_name,
         CASE CAST(n_nationkey % 5 AS INT) WHEN 0 THEN 'PL' WHEN 1 THEN 'DE' WHEN 2 THEN 'US' WHEN 3 THEN 'IE' ELSE 'ZZ' END AS hq_country,
         (c_custkey % 3 = 0) AS eu_entity_verified,
         CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'REMOTE_ONLY' WHEN 1 THEN 'REMOTE_FRIENDLY' ELSE 'UNKNOWN' END AS remote_posture,
         (c_custkey % 9 <> 0) AS is_active, CAST(c_custkey % 97 AS INT) AS signal_score,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('https://', lower(c_name), '.example.com') END AS careers_url,
         CASE WHEN c_custkey % 2 = 0 THEN 'greenhouse' END AS ats_provider,
         CAST(NULL AS BIGINT) AS total_jobs_count
  FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "company_ats_v": """
  SELECT s_suppkey AS company_ats_id, s_suppkey AS company_id, CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' ELSE 'workable' END AS provider,
         concat('slug-', CAST(s_suppkey % 60 AS VARCHAR(10))) AS ats_slug,
         (s_suppkey % 10 <> 0) AS is_active, {ts} '2001-08-02 00:00:00' - INTERVAL '10' DAY AS created_at,
         CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN {ts} '2001-08-02 00:00:00' - INTERVAL '5' DAY ELSE {ts} '2001-08-02 00:00:00' - INTERVAL '1' DAY END AS last_sync_at
  FROM supplier""",
    "compliance_reports_v": """
  SELECT CAST(l_orderkey AS VARCHAR(20)) AS job_id, concat('v', CAST(l_linenumber AS VARCHAR(10))) AS policy_version, (l_discount > 0.08) AS hard_geo_flag
  FROM lineitem WHERE l_linenumber <= 2""",
}


def oracle(sql: str, *views: str) -> str:
    """A query over views, for DuckDB. Views that its text names are put before it."""
    used = [v for v in VIEWS if v in sql or v in views]
    ctes = ",\n".join(f"{v} AS ({VIEWS[v].format(ts='TIMESTAMP')})" for v in used)
    body = sql.strip()
    if not used:
        return body
    return f"WITH {ctes},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes}\n{body}"


class Tables:
    """The canonical tables over a folder of test tables, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        bases = [t for t in ("lineitem", "orders", "customer", "nation", "supplier") if f" {t}" in text]
        for t in bases:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
        return self.spark.sql(text.replace("{ts}", "TIMESTAMP_NTZ"), **{t: self.read(t) for t in bases})

    @cached_property
    def jobs(self) -> DataFrame:
        return self.view("jobs_v")

    @cached_property
    def job_sources(self) -> DataFrame:
        return self.view("job_sources_v")

    @cached_property
    def companies(self) -> DataFrame:
        return self.view("companies_v")

    @cached_property
    def company_ats(self) -> DataFrame:
        return self.view("company_ats_v")

    @cached_property
    def compliance_reports(self) -> DataFrame:
        return self.view("compliance_reports_v")

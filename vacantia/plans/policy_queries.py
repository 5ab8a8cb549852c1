"""Geography and the whole compliance policy over known cases, and over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.functions import geo
from vacantia.plans.registry import query
from vacantia.plans.rule_queries import chosen
from vacantia.plans.table_queries import rows
from vacantia.plans.text_queries import cases

cases("c04_geo", "title description scope", [
    ("Engineer", "", "Berlin", "eu_member_state", "explicit_country"), ("Engineer", "", "Spain; Brazil", "eu_region", "mixed_region"), ("Engineer", "", "London, New York", "non_eu", "new york"),
    ("Engineer", "", "Remote - US: Select locations", "non_eu", "explicit_country"), ("Engineer", "", "DE", "non_eu", "explicit_country"), ("Engineer", "", "EMEA", "eu_region", "emea"),
    ("Engineer", "", "APAC", "non_eu", "apac"), ("Engineer", "", "EMEA; United States", "non_eu", "united states"), ("Engineer", "", "Oslo", "eu_member_state", "explicit_country"),
    ("Engineer, Poland", "", "", "eu_member_state", "explicit_country"), ("Sr IT Project", "", "", "unknown", None),
    ("Engineer", "Localization:\n\nPoland", "", "eu_member_state", "poland"), ("Engineer", "## Localization\n\nPoland and more", "", "eu_member_state", "poland"), ("Engineer", "Localization\n \n\n  Norway\n\nSpain", "", "eu_region", "norway"),
    ("Engineer", "<h2>Localization</h2><p>Czech&nbsp;Republic</p>", "", "eu_member_state", "czech republic"), ("Engineer", "Localization:\n\n## Next\nPoland", "", "unknown", None),
    ("Engineer", "Localization: Poland or Germany", "", "eu_member_state", "germany"), ("Engineer", "<h2>Localization</h2> Norway <h2>x</h2>", "", "eu_region", "norway"),
    ("Engineer", "We hire across Europe", "", "eu_region", "desc_europe"), ("Engineer", "offices in North America, Europe and Asia Pacific", "", "unknown", None),
    ("Engineer", "covering EMEA", "", "eu_region", "desc_emea"), ("Engineer", "covering EMEA and APAC", "", "unknown", None), ("Engineer", "must be UK based", "", "uk", "desc_uk_based"),
    ("Engineer", "overlap with CET hours", "", "eu_region", "desc_timezone_cet"), ("Engineer in Scotland", "", "", "uk", "scotland"), (None, None, None, "unknown", None),
], lambda a, b, c: [F.inline(F.array(geo.geography(a, b, c)))], "geo_class geo_reason")

POLICY = [
    ("Engineer", "US only", "Remote", "unknown", "non_eu", 0, "rejected"), ("Engineer", "", "Remote - Poland", "remote_region_locked", "eu_member_state", 90, "approved"), ("Engineer", "", "Fully remote, Poland", "remote_region_locked", "eu_member_state", 90, "approved"),
    ("Remote Engineer", "We hire across Europe", "", "remote_only", "eu_region", 100, "approved"), ("Engineer", "remote friendly in Europe", "", "remote_optional", "eu_region", 60, "review"), ("Engineer", "", "Berlin", "unknown", "eu_member_state", 55, "review"),
    ("Engineer", "", "Hybrid, Berlin", "non_remote", "eu_member_state", 0, "rejected"), ("Engineer", "", "", "unknown", "unknown", 20, "rejected"),
]
OUT = ("remote_class", "geo_class", "compliance_score", "compliance_status")
query("c07_policy", "SELECT CAST(n AS INTEGER) AS n, remote_class, geo_class, compliance_score, compliance_status FROM (VALUES " + ", ".join(f"({i}, '{r[3]}', '{r[4]}', {r[5]}, '{r[6]}')" for i, r in enumerate(POLICY)) + ") v(n, remote_class, geo_class, compliance_score, compliance_status)")(
    lambda t: geo.policy(t.spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(POLICY)], "n int, title string, description string, remote_scope string")).select("n", *OUT)
)
cases("c05_geo_text", "title description", [
    ("Engineer", "US-based only", "non_eu", "us-based only"), ("Engineer", "remote in Canada", "non_eu", "remote in canada"), ("Engineer", "LATAM", "non_eu", "latam"), ("Engineer", "offices in NY, TX and WA", "non_eu", "us_state_codes>=3"),
    ("Engineer", "EU only", "eu_explicit", "eu"), ("Engineer", "based in Spain", "eu_member_state", "spain"), ("Engineer", "Norway", "eu_region", "norway"), ("Engineer", "across Europe", "eu_region", "europe"),
    ("Engineer", "London", "uk", "london"), ("Engineer, UK", "", "uk", "uk"), ("Engineer", "", "unknown", None), (None, None, "unknown", None),
], lambda a, b: [F.inline(F.array(geo.geography_of_text(a, b)))], "geo_class matched_keyword")

# Postings by their keys: a scope decides before a description does, a hard restriction before both.
BY_SCOPE = (("Berlin", "eu_member_state", "explicit_country"), ("EMEA", "eu_region", "emea"), ("Brazil", "non_eu", "explicit_country"), ("Oslo", "eu_member_state", "explicit_country"), ("Spain; Brazil", "eu_region", "mixed_region"), ("APAC", "non_eu", "apac"), ("Anywhere", None, None))
BY_DESCRIPTION = (("We hire across Europe", "eu_region", "desc_europe"), ("must be UK based", "uk", "desc_uk_based"), ("overlap with CET hours", "eu_region", "desc_timezone_cet"), ("Localization: Norway", "eu_region", "norway"), ("US only", None, None), ("covering EMEA and APAC", None, None), ("", None, None))
BY_TITLE = (("Remote Engineer", "remote_only"), ("Hybrid Engineer", "non_remote"), ("Remote-friendly Engineer", "remote_optional"))
PLACED = f"SELECT job_id, {chosen([v for v, _ in BY_TITLE])} AS title, {chosen([v for v, *_ in BY_DESCRIPTION])} AS description, {chosen([v for v, *_ in BY_SCOPE])} AS remote_scope FROM jobs_v"
told = lambda table: ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in table)
KNOWN = f"""
p AS ({PLACED}), s(remote_scope, geo, reason) AS (VALUES {told(BY_SCOPE)}), d(description, geo, reason) AS (VALUES {told(BY_DESCRIPTION)}), r(title, remote) AS (VALUES {told(BY_TITLE)}),
k AS (SELECT p.*, coalesce(s.geo, d.geo, 'unknown') AS geo, coalesce(s.reason, d.reason) AS reason, coalesce(r.remote, 'unknown') AS remote, coalesce(p.description = 'US only', false) AS hard
  FROM p LEFT JOIN s ON s.remote_scope = p.remote_scope LEFT JOIN d ON d.description = p.description LEFT JOIN r ON r.title = p.title)"""
query("c04_geo_rows", f"WITH {KNOWN} SELECT job_id, geo AS geo_class, reason AS geo_reason FROM k", "jobs_v")(
    lambda t: rows(t, PLACED).select("job_id", geo.geography(F.col("title"), F.col("description"), F.col("remote_scope")).alias("g")).select("job_id", "g.*")
)
query("c07_policy_rows", f"""
WITH {KNOWN}
SELECT job_id, CASE WHEN hard THEN 'unknown' ELSE remote END AS remote_class, CASE WHEN hard THEN 'non_eu' ELSE geo END AS geo_class,
  CASE WHEN hard OR remote = 'non_remote' OR geo = 'non_eu' THEN 0 WHEN geo = 'unknown' THEN 20 WHEN remote = 'remote_only' THEN 100 WHEN remote = 'remote_optional' THEN 60 ELSE 55 END AS compliance_score,
  CASE WHEN hard OR remote = 'non_remote' OR geo IN ('non_eu', 'unknown') THEN 'rejected' WHEN remote = 'remote_only' THEN 'approved' ELSE 'review' END AS compliance_status FROM k""", "jobs_v")(
    lambda t: geo.policy(rows(t, PLACED)).select("job_id", *OUT)
)

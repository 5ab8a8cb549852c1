"""Every provider's payloads and the discovery rules over whole tables: each posting, company or board of the bound
tables as its provider would hand it over, against what is known of it."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions import geo
from vacantia.functions import text as x
from vacantia.plans.bindings import AS_OF
from vacantia.plans.registry import query
from vacantia.plans.source_queries import NAMES
from vacantia.plans.table_queries import rows
from vacantia.sources import boards
from vacantia.sources import discovery as d

V = "VARCHAR(200)"
#: What @K, @T, @S and @A stand for in a template: a posting's key, its title, its board and an amount.
PARTS = {"@K": f"CAST(k AS {V})", "@T": "title", "@S": f"concat('board-', CAST(k % 5 AS {V}))", "@A": f"CAST(1000 + k % 9000 AS {V})", "@N": f"concat('Board ', CAST(k % 5 AS {V}))"}
PLACES = "@L"


def _places(names: tuple[str, ...]) -> str:
    return "CASE CAST(k % 3 AS INT) WHEN 0 THEN '{}' WHEN 1 THEN '{}' ELSE '{}' END".format(*(n.replace("'", "''") for n in names))


def told(template: str, places: tuple[str, ...] = ("", "", "")) -> str:
    """SQL of a template."""
    pieces = [PARTS.get(p) or (_places(places) if p == PLACES else "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'") for p in re.split("(@[KTSANL])", template) if p]
    return "concat(" + ", ".join([*pieces, "''"]) + ")"


def filled(template: str, places: tuple[str, ...]) -> Column:
    """The same as a column."""
    out = F.lit(template)
    for mark, sql in PARTS.items():
        out = F.replace(out, F.lit(mark), F.expr(sql))
    return F.replace(out, F.lit(PLACES), F.expr(_places(places)))


#: Per provider: places, a payload, and what becomes of it: address, company, description, remote or not (by place), scopes, department, least salary, currency, period.
POSTED = {
    "greenhouse": (("Remote - Europe", "Berlin", "Spain (Remote)"), {"id": "@K", "title": " @T ", "absolute_url": "HTTPS://Boards.example.com/a/@K?utm_source=x&b=1#f", "location": {"name": "@L"}, "updated_at": "2024-05-01T10:00:00Z", "content": "<p>Hi @K</p>", "departments": [{"name": "R&D"}], "pay_bounds": [{"min_value": "@A", "max_value": "99999", "currency": "eur", "unit": "year"}]},
                   ("https://boards.example.com/a/@K?b=1", "@N", "<p>Hi @K</p>", (True, False, True), ("europe", "berlin", "spain (remote)"), "R&D", "@A", "EUR", "yearly")),
    "lever": (("Berlin", "Oslo", "Rome"), {"id": "@K", "text": "@T", "hostedUrl": "https://jobs.example.com/@K", "categories": {"location": "@L", "team": "Core"}, "workplaceType": "remote", "createdAt": 1714557600000, "description": "Intro @K", "lists": [{"text": "You", "content": "<li>a</li>"}], "additional": "Bye"},
              ("https://jobs.example.com/@K", "@N", "Intro @K\n\n<h3>You</h3>\n<li>a</li>\n\nBye", (True, True, True), ("berlin", "oslo", "rome"), "Core", None, None, None)),
    "ashby": (("Paris", "Nice", "Lille"), {"id": "@K", "title": "@T", "location": "@L", "secondaryLocations": [{"location": "Lyon"}], "isRemote": True, "workplaceType": "Hybrid", "publishedAt": "2024-05-01", "descriptionPlain": "Text @K", "departmentName": "Eng"},
              ("https://jobs.ashbyhq.com/@S/@K", "@N", "Text @K", (False, False, False), ("paris; lyon; hybrid", "nice; lyon; hybrid", "lille; lyon; hybrid"), "Eng", None, None, None)),
    "workable": (("Rome", "Milan", "Turin"), {"shortcode": "@K", "title": "@T", "location": {"city": "@L", "country": "Italy"}, "remote": True, "published": "2024-05-01", "description": "A", "requirements": "B @K", "department": ["Ops"], "salary": {"min": "@A", "max": 99999, "currency": "usd", "period": "hourly"}},
                 ("https://apply.workable.com/@S/j/@K/", "@N", "A\n\n<h3>Requirements</h3>\nB @K", (True, True, True), ("rome, italy", "milan, italy", "turin, italy"), "Ops", "@A", "USD", "hourly")),
    "smartrecruiters": (("Porto", "Braga", "Faro"), {"id": "@K", "name": "@T", "location": {"city": "@L", "country": "pt", "remote": False}, "releasedDate": "2024-05-01", "company": {"name": "Big Co @K"}, "department": {"label": "IT"}, "jobAd": {"sections": {"jobDescription": {"title": "Job", "text": "Do"}, "companyDescription": {"text": "We"}}}},
                        ("https://jobs.smartrecruiters.com/@S/@K", "Big Co @K", "We\n\n<h3>Job</h3>\nDo", (False, False, False), ("porto - pt", "braga - pt", "faro - pt"), "IT", None, None, None)),
    "recruitee": (("Gdansk", "Lodz", "Sopot"), {"id": "@K", "title": "@T", "location": "@L", "city": "@L", "country": "Poland", "careers_url": "https://c.example.com/@K", "department": "X", "remote": True, "created_at": "2024-05-01", "translations": {"pl": {"description": "PL"}, "en": {"description": "EN", "requirements": "R @K"}}},
                  ("https://c.example.com/@K", "@N", "EN\n\n<h3>Requirements</h3>\nR @K", (True, True, True), ("gdansk, poland", "lodz, poland", "sopot, poland"), "X", None, None, None)),
    "personio": (("Remote", "Madrid", "Remote Spain"), {"id": "@K", "name": "@T", "office": "@L", "department": "Y", "createdAt": "2024-05-01", "description": "<h3>T</h3>\nV @K"},
                 ("", "@N", "<h3>T</h3>\nV @K", (True, False, True), ("remote", "madrid", "remote spain"), "Y", None, None, None)),
    "teamtailor": (("Malmo", "Lund", "Kiruna"), {"id": "@K", "attributes": {"title": "@T", "body": " B @K ", "remote-status": "full", "salary-min": "@A", "salary-currency": "SEK", "salary-time-unit": "monthly", "created-at": "2024-05-01"}, "links": {"careersite-job-url": "https://t.example.com/@K"}, "relationships": {"department": {"data": {"id": "2"}}, "locations": {"data": [{"id": "4"}]}}, "included": [{"type": "departments", "id": "2", "attributes": {"name": "Data"}}, {"type": "locations", "id": "4", "attributes": {"city": "@L", "country": "Sweden"}}]},
                   ("https://t.example.com/@K", "@N", "B @K", (True, True, True), ("malmo, sweden; remote", "lund, sweden; remote", "kiruna, sweden; remote"), "Data", "@A", "SEK", "monthly")),
    "traffit": (("Lodz", "Gdynia", "Radom"), {"id": "@K", "url": "https://f.example.com/@K", "valid_start": "2024-05-01", "advert": {"name": "@T", "values": [{"field_id": "description", "value": "D @K"}, {"field_id": "what_we_offer", "value": "O"}]}, "options": {"job_location": '{"locality": "@L", "country": "Poland"}', "remote": "1", "branches": "IT"}},
                ("https://f.example.com/@K", "@N", "D @K\n\n<h3>What we offer</h3>\nO", (True, True, True), ("lodz, poland", "gdynia, poland", "radom, poland"), "IT", None, None, None)),
    "jobadder": (("Oslo", "Bergen", "Narvik"), {"adId": "@K", "title": "@T", "categories": {"location": "@L", "locationType": "Work from home"}, "locationText": "x", "postedAt": "2024-05-01", "description": "D @K", "summary": "S", "bulletPoints": ["a", "b"], "department": {"name": "HR"}, "salary": {"min": "@A", "max": 99999, "currency": "nok", "ratePer": "Hour"}},
                 ("https://jobadder.com/jobs/@K", "@N", "<ul><li>a</li><li>b</li></ul>\n\nD @K\n\n<h3>Summary</h3>\nS", (True, True, True), ("oslo", "bergen", "narvik"), "HR", "@A", "NOK", "hourly")),
    "breezy": (("", "", ""), {"_id": "@K", "name": "@T", "state": "published", "location": {"name": "@L", "is_remote": True}, "tags": ["x"], "description": "D @K", "department": {"name": " Z "}, "published_date": "2024-05-01", "salary_min": "@A", "salary_max": 99999, "salary_currency": "eur"},
               ("https://@S.breezy.hr/p/@K", "@N", "D @K", (True, True, True), ("remote", "remote", "remote"), "Z", "@A", "EUR", None)),
}
#: Postings without a title, and payloads that are none, drop out.
DROPPED = "k % 11 = 0 OR k % 13 = 0"


def payloads(t, provider: str):
    places, payload, _ = POSTED[provider]
    raw = rows(t, "SELECT k, CASE WHEN k % 11 = 0 THEN '' ELSE title END AS title FROM jobs_v")
    whole = F.when(F.col("k") % 13 == 0, "{").otherwise(filled(json.dumps(payload), places))
    return raw.select(F.expr(PARTS["@S"]).alias("slug"), whole.alias("payload"))


def _expected(provider: str) -> str:
    places, _, (url, company, description, remote, scopes, department, low, currency, period) = POSTED[provider]
    text = lambda v: f"CAST(NULL AS {V})" if v is None else told(v, places)
    flag = "CASE CAST(k % 3 AS INT) WHEN 0 THEN {} WHEN 1 THEN {} ELSE {} END".format(*(str(r).lower() for r in remote))
    values = (told(f"{provider}:@S:@K"), text(url), "title", text(company), text(description), flag, _places(scopes), text(department), "CAST(NULL AS INTEGER)" if low is None else f"CAST({PARTS[low]} AS INTEGER)", text(currency), text(period))
    return "SELECT " + ", ".join(f"{v} AS {n}" for v, n in zip(values, NAMES, strict=True)) + f" FROM jobs_v WHERE NOT ({DROPPED})"


for _number, _provider in enumerate(POSTED, 3):
    query(f"s{_number:02d}_{_provider}_rows", _expected(_provider), "jobs_v")(lambda t, p=_provider: boards.normalise(payloads(t, p), p, "2024-06-01").select(*NAMES))

query("s16_probe_rows", f"SELECT count(*) AS jobs_total, count(*) FILTER (k % 3 <> 1) AS remote_hits FROM jobs_v WHERE NOT ({DROPPED})")(lambda t: boards.probe(boards.normalise(payloads(t, "greenhouse"), "greenhouse", "2024-06-01")).drop("recent_at"))

# Discovery.
ADDRESSES = f"""SELECT company_ats_id, concat('co', CAST(company_ats_id AS {V})) AS slug, CASE CAST(company_ats_id % 8 AS INT) WHEN 0 THEN 'personio' WHEN 1 THEN 'jobadder' WHEN 2 THEN 'lever' WHEN 3 THEN 'greenhouse' WHEN 4 THEN 'recruitee' WHEN 5 THEN 'lever' WHEN 6 THEN 'jobadder' ELSE 'other' END AS provider,
  CASE CAST(company_ats_id % 8 AS INT) WHEN 0 THEN 'https://@.jobs.personio.com/x' WHEN 1 THEN 'https://app.jobadder.com/jobboard/@/' WHEN 2 THEN 'https://jobs.lever.co/@/1' WHEN 3 THEN 'https://boards.greenhouse.io/@' WHEN 4 THEN 'https://@.recruitee.com/o/1' WHEN 5 THEN 'https://jobs.lever.co/' WHEN 6 THEN 'https://app.jobadder.com/x/@' ELSE 'https://@.example.com/a' END AS shape FROM company_ats_v"""
query("s18_address_rows", f"SELECT company_ats_id, CASE WHEN company_ats_id % 8 < 5 THEN slug END AS slug FROM ({ADDRESSES})", "company_ats_v")(
    lambda t: rows(t, ADDRESSES).select("company_ats_id", d.slug_of_address(F.replace("shape", F.lit("@"), F.col("slug")), F.col("provider")).alias("slug"))
)
query("s20_careers_rows", f"SELECT company_ats_id, CASE WHEN company_ats_id % 8 IN (2, 3, 4) THEN provider END AS provider, CASE WHEN company_ats_id % 8 IN (2, 3, 4) THEN slug END AS slug FROM ({ADDRESSES}) WHERE company_ats_id % 8 IN (2, 3, 4, 7)", "company_ats_v")(
    # Every other company's page is sent on to its board, the others' pages name it.
    lambda t: rows(t, ADDRESSES).filter("company_ats_id % 8 IN (2, 3, 4, 7)").withColumn("url", F.replace("shape", F.lit("@"), F.col("slug")))
    .select("company_ats_id", d.board_of_page(F.when(F.col("company_ats_id") % 16 < 8, F.col("url")).otherwise(""), F.when(F.col("company_ats_id") % 16 >= 8, F.concat(F.lit('<a href="'), "url", F.lit('">Jobs</a>'))).otherwise("")).alias("b")).select("company_ats_id", "b.provider", "b.slug")
)
query("s19_certificate_rows", f"SELECT DISTINCT concat('cert-', CAST(company_id % 400 AS {V})) AS slug FROM companies_v WHERE company_id % 3 <> 2")(
    lambda t: d.certificate_slugs(rows(t, f"SELECT company_id, concat('cert-', CAST(company_id % 400 AS {V})) AS s FROM companies_v").select(
        F.when(F.col("company_id") % 3 == 0, F.concat(F.lit("*."), "s", F.lit(".recruitee.com\nwww.recruitee.com"))).when(F.col("company_id") % 3 == 1, F.concat(F.lit("A.recruitee.com\r\n"), F.upper("s"), F.lit(".recruitee.com"))).otherwise(F.lit("*.recruitee")).alias("name_value")).filter("name_value <> '*.recruitee'"))
)
query("s21_harvest_rows", f"SELECT 'traffit' AS provider, concat('firm', CAST(company_id AS {V})) AS slug, CASE CAST(company_id % 4 AS INT) WHEN 0 THEN 3 WHEN 1 THEN 2 END AS score FROM companies_v WHERE company_id % 4 < 2", "companies_v")(
    # In a page and as the final address: 3; the final address alone: 2; a page alone is not enough, and noise never.
    lambda t: d.harvest(rows(t, f"SELECT company_id AS c, concat('https://firm', CAST(company_id AS {V}), '.traffit.com/x') AS u FROM companies_v").select(F.explode(
        F.when(F.col("c") % 4 == 0, F.array(F.struct(F.col("u").alias("text"), F.lit("html").alias("evidence")), F.struct(F.col("u").alias("text"), F.lit("final_url").alias("evidence"))))
        .when(F.col("c") % 4 == 1, F.array(F.struct(F.col("u").alias("text"), F.lit("final_url").alias("evidence")))).when(F.col("c") % 4 == 2, F.array(F.struct(F.col("u").alias("text"), F.lit("html").alias("evidence"))))
        .otherwise(F.array(F.struct(F.concat(F.lit("https://www.teamtailor.com/jobs https://demo-"), F.col("c").cast("string"), F.lit(".breezy.hr")).alias("text"), F.lit("final_url").alias("evidence"))))).alias("e")).select("e.*"))
)
query("s22_listed_rows", f"SELECT slug FROM (SELECT DISTINCT concat('list', CAST(company_id % 300 AS {V})) AS slug FROM companies_v WHERE company_id % 3 = 0 UNION SELECT concat('known', CAST(company_ats_id % 20 AS {V})) FROM company_ats_v)", "companies_v", "company_ats_v")(
    lambda t: d.listed_slugs(rows(t, f"SELECT CASE CAST(company_id % 3 AS INT) WHEN 0 THEN concat('  list', CAST(company_id % 300 AS {V}), ' ') WHEN 1 THEN '# comment' ELSE '' END AS value FROM companies_v").filter("value <> ''").filter("NOT value LIKE '#%'"), rows(t, f"SELECT concat('known', CAST(company_ats_id % 20 AS {V})) AS slug FROM company_ats_v"))
)
NAMED = "SELECT company_id, CASE CAST(company_id % 3 AS INT) WHEN 0 THEN legal_name WHEN 1 THEN concat(legal_name, ' Data Ltd') ELSE concat(legal_name, ' Inc.') END AS name FROM companies_v"
_BASE = "replace(lower(legal_name), '#', '')"
_GUESSED = ", ".join(f"concat(b, '{s}'), concat(b, '-{s}')" for s in d.SUFFIXES)
_GUESSED2 = ", ".join(f"concat(b, '-data{s}'), concat(b, '-data-{s}'), concat(b, 'data{s}'), concat(b, 'data-{s}')" for s in d.SUFFIXES)
query("s23_guess_rows", f"SELECT company_id, array_to_string((CASE WHEN company_id % 3 = 1 THEN [concat(b, '-data'), concat(b, 'data'), {_GUESSED2}] ELSE [b, {_GUESSED}] END)[1:30], ',') AS guesses FROM (SELECT company_id, {_BASE} AS b FROM companies_v)", "companies_v")(
    lambda t: rows(t, NAMED).select("company_id", F.array_join(d.guesses(F.col("name")), ",").alias("guesses"))
)
SLUGS = f"SELECT company_id, CASE CAST(company_id % 5 AS INT) WHEN 0 THEN concat('firm', CAST(company_id AS {V})) WHEN 1 THEN 'ab' WHEN 2 THEN concat('demo-', CAST(company_id AS {V})) WHEN 3 THEN concat('my-careers', CAST(company_id AS {V})) ELSE '  x ' END AS slug FROM companies_v"
query("f22_slug_rows", "SELECT company_id, company_id % 5 = 0 AS ok FROM companies_v")(lambda t: rows(t, SLUGS).select("company_id", d.valid_slug(F.col("slug")).alias("ok")))
PROBED = "SELECT company_ats_id, provider, company_ats_id % 5 AS total, company_ats_id % 3 AS remote, last_sync_at FROM company_ats_v"
query("f21_gate_rows", f"SELECT company_ats_id, total >= 1 AND remote >= 1 AND (last_sync_at IS NULL OR last_sync_at >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY) AS ok FROM ({PROBED})", "company_ats_v")(
    lambda t: rows(t, PROBED).select("company_ats_id", d.passes_gate(F.col("total"), F.col("remote"), F.col("last_sync_at"), AS_OF, days=3).alias("ok"))
)
query("d13_promotion_rows", f"SELECT company_ats_id, CASE WHEN company_ats_id % 3 = 0 AND total <= 2 THEN 'needs_token' WHEN total >= 1 THEN 'promoted' ELSE 'rejected' END AS status FROM ({PROBED})", "company_ats_v")(
    lambda t: rows(t, PROBED).select("company_ats_id", d.promotion(F.when(F.col("company_ats_id") % 3 == 0, "teamtailor").otherwise(F.col("provider")), F.col("total") >= 1, F.col("total") > 2).alias("status"))
)

# The older text geography, and HTML as it is stored, over every posting.
BY_TEXT = (("US-based only", "non_eu", "us-based only"), ("remote in Canada", "non_eu", "remote in canada"), ("offices in NY, TX and WA", "non_eu", "us_state_codes>=3"), ("EU only", "eu_explicit", "eu"), ("based in Spain", "eu_member_state", "spain"), ("Norway", "eu_region", "norway"), ("across Europe", "eu_region", "europe"), ("London", "uk", "london"), ("all over the UK", "uk", "uk"), ("nowhere", "unknown", None))
_PICK = lambda i: "CASE CAST(k % 10 AS INT) " + " ".join(f"WHEN {n} THEN " + ("NULL" if r[i] is None else f"'{r[i]}'") for n, r in enumerate(BY_TEXT)) + " END"
query("c05_geo_text_rows", f"SELECT job_id, {_PICK(1)} AS geo_class, {_PICK(2)} AS matched_keyword FROM jobs_v")(
    lambda t: rows(t, f"SELECT job_id, 'Engineer' AS title, {_PICK(0)} AS description FROM jobs_v").select("job_id", F.inline(F.array(geo.geography_of_text(F.col("title"), F.col("description")))))
)
HTML = '<script>x(@K)</script><h2>@T</h2><p>Hello <b>World</b> &amp; caf&eacute; @K</p><ul><li>One</li><li>Two @K</li></ul><p>&nbsp;</p><div>In <em>it</em></div>****<p>Acme is an equal opportunity employer. @K</p><hr>[1.2](http://1.2)'
MARKDOWN = "## @T\n\nHello World & café @K\n\n- One\n- Two @K\n\nIn _it_\n\n---\n1.2"
query("x04_markdown_rows", f"SELECT job_id, md5({told(MARKDOWN)}) AS hash FROM jobs_v")(lambda t: t.jobs.select("job_id", F.md5(x.clean_description(filled(HTML, ("", "", ""))).cast("binary")).alias("hash")))

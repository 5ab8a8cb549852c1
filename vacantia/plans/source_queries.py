"""Board payloads and discovery rules over known cases."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from vacantia.plans.registry import query
from vacantia.sources import boards

CASES = {
    "s03_greenhouse": ("greenhouse", {"id": 7, "title": " Engineer ", "absolute_url": "HTTPS://Boards.example.com/a?utm_source=x&b=1#f", "location": {"name": "Remote - Europe"}, "updated_at": "2024-05-01T10:00:00Z", "content": "<p>Hi</p>", "departments": [{"name": "R&D"}], "pay_bounds": [{"min_value": "50000", "max_value": "60000", "currency": "eur", "unit": "year"}]}, ("greenhouse:acme-corp:7", "https://boards.example.com/a?b=1", "Engineer", "Acme Corp", "<p>Hi</p>", True, "europe", "R&D", 50000, "EUR", "yearly")),
    "s04_lever": ("lever", {"id": "x1", "text": "Dev", "hostedUrl": "https://jobs.example.com/x1", "categories": {"location": "Berlin", "team": "Core"}, "workplaceType": "remote", "createdAt": 1714557600000, "description": "Intro", "lists": [{"text": "You", "content": "<li>a</li>"}], "additional": "Bye"}, ("lever:acme-corp:x1", "https://jobs.example.com/x1", "Dev", "Acme Corp", "Intro\n\n<h3>You</h3>\n<li>a</li>\n\nBye", True, "berlin", "Core", None, None, None)),
    "s05_ashby": ("ashby", {"id": "a1", "title": "Dev", "location": "Paris", "secondaryLocations": [{"location": "Lyon"}], "isRemote": True, "workplaceType": "Hybrid", "publishedAt": "2024-05-01", "descriptionPlain": "Text", "departmentName": "Eng"}, ("ashby:acme-corp:a1", "https://jobs.ashbyhq.com/acme-corp/a1", "Dev", "Acme Corp", "Text", False, "paris; lyon; hybrid", "Eng", None, None, None)),
    "s06_workable": ("workable", {"shortcode": "W1", "title": "Dev", "location": {"city": "Rome", "country": "Italy"}, "remote": True, "published": "2024-05-01", "description": "A", "requirements": "B", "department": ["Ops"], "salary": {"min": 100, "max": 200, "currency": "usd", "period": "hourly"}}, ("workable:acme-corp:W1", "https://apply.workable.com/acme-corp/j/W1/", "Dev", "Acme Corp", "A\n\n<h3>Requirements</h3>\nB", True, "rome, italy", "Ops", 100, "USD", "hourly")),
    "s07_smartrecruiters": ("smartrecruiters", {"id": "9", "name": "Dev", "location": {"city": "Porto", "country": "pt", "remote": False}, "releasedDate": "2024-05-01", "company": {"name": "Big Co"}, "department": {"label": "IT"}, "jobAd": {"sections": {"jobDescription": {"title": "Job", "text": "Do"}, "companyDescription": {"text": "We"}}}}, ("smartrecruiters:acme-corp:9", "https://jobs.smartrecruiters.com/acme-corp/9", "Dev", "Big Co", "We\n\n<h3>Job</h3>\nDo", False, "porto - pt", "IT", None, None, None)),
    "s08_recruitee": ("recruitee", {"id": 3, "title": "Dev", "location": "Gdansk", "city": "Gdansk", "country": "Poland", "careers_url": "https://c.example.com/3", "department": "X", "remote": True, "created_at": "2024-05-01", "translations": {"pl": {"description": "PL"}, "en": {"description": "EN", "requirements": "R"}}}, ("recruitee:acme-corp:3", "https://c.example.com/3", "Dev", "Acme Corp", "EN\n\n<h3>Requirements</h3>\nR", True, "gdansk, poland", "X", None, None, None)),
    "s09_personio": ("personio", {"id": "5", "name": "Dev", "office": "Remote", "department": "Y", "createdAt": "2024-05-01", "description": "<h3>T</h3>\nV"}, ("personio:acme-corp:5", "", "Dev", "Acme Corp", "<h3>T</h3>\nV", True, "remote", "Y", None, None, None)),
    "s10_teamtailor": ("teamtailor", {"id": "11", "attributes": {"title": "Dev", "body": " B ", "remote-status": "full", "salary-min": 10, "salary-currency": "SEK", "salary-time-unit": "monthly", "created-at": "2024-05-01"}, "links": {"careersite-job-url": "https://t.example.com/11"}, "relationships": {"department": {"data": {"id": "2"}}, "locations": {"data": [{"id": "4"}]}}, "included": [{"type": "departments", "id": "2", "attributes": {"name": "Data"}}, {"type": "locations", "id": "4", "attributes": {"city": "Malmo", "country": "Sweden"}}]}, ("teamtailor:acme-corp:11", "https://t.example.com/11", "Dev", "Acme Corp", "B", True, "malmo, sweden; remote", "Data", 10, "SEK", "monthly")),
    "s11_traffit": ("traffit", {"id": 21, "url": "https://f.example.com/21", "valid_start": "2024-05-01", "advert": {"name": "Dev", "values": [{"field_id": "description", "value": "D"}, {"field_id": "what_we_offer", "value": "O"}]}, "options": {"job_location": json.dumps({"locality": "Lodz", "country": "Poland"}), "remote": "1", "branches": "IT"}}, ("traffit:acme-corp:21", "https://f.example.com/21", "Dev", "Acme Corp", "D\n\n<h3>What we offer</h3>\nO", True, "lodz, poland", "IT", None, None, None)),
    "s12_jobadder": ("jobadder", {"adId": 31, "title": "Dev", "categories": {"location": "Oslo", "locationType": "Work from home"}, "locationText": "x", "postedAt": "2024-05-01", "description": "D", "summary": "S", "bulletPoints": ["a", "b"], "department": {"name": "HR"}, "salary": {"min": 30, "max": 40, "currency": "nok", "ratePer": "Hour"}}, ("jobadder:acme-corp:31", "https://jobadder.com/jobs/31", "Dev", "Acme Corp", "<ul><li>a</li><li>b</li></ul>\n\nD\n\n<h3>Summary</h3>\nS", True, "oslo", "HR", 30, "NOK", "hourly")),
    "s13_breezy": ("breezy", {"_id": "b1", "name": "Dev", "state": "published", "location": {"name": "", "is_remote": True}, "tags": ["x"], "description": "D", "department": {"name": " Z "}, "published_date": "2024-05-01", "salary_min": 5, "salary_max": 6, "salary_currency": "eur"}, ("breezy:acme-corp:b1", "https://acme-corp.breezy.hr/p/b1", "Dev", "Acme Corp", "D", True, "remote", "Z", 5, "EUR", None)),
}
NAMES = ("job_id", "source_url", "title", "company_name", "description", "remote_source_flag", "remote_scope", "department", "salary_min", "salary_currency", "salary_period")


def _sql(value) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else str(value).lower() if isinstance(value, bool) else f"CAST({value} AS INTEGER)" if isinstance(value, int) else f"'{value.replace(chr(39), chr(39) * 2)}'"


for _name, (_provider, _payload, _expected) in CASES.items():
    _values = ", ".join(f"{'CAST(NULL AS INTEGER)' if n == 'salary_min' and v is None else _sql(v)} AS {n}" for n, v in zip(NAMES, _expected, strict=True))
    query(_name, f"SELECT {_values}")(
        # A second payload without a title and a third that is no JSON drop out.
        lambda t, p=_provider, b=_payload: boards.normalise(t.spark.createDataFrame([("acme-corp", json.dumps(b)), ("acme-corp", json.dumps({"id": 1})), ("acme-corp", "{")], "slug string, payload string"), p, "2024-06-01").select(*NAMES)
    )


def _all(t):
    rows = [(p, "acme-corp", json.dumps(b)) for p, b, _ in CASES.values()]
    raw = t.spark.createDataFrame(rows, "provider string, slug string, payload string")
    parts = [boards.normalise(raw.filter(F.col("provider") == p), p, "2024-06-01") for p in boards.PROVIDERS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return boards.probe(out).drop("recent_at")


query("s16_probe", "SELECT CAST(11 AS BIGINT) AS jobs_total, CAST(9 AS BIGINT) AS remote_hits")(_all)

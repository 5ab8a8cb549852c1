"""Landed payloads of every posting: salaries in structured fields, shapes, encodings, and the whole way in."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.functions import payload
from vacantia.functions.classify import EUROS
from vacantia.plans import ingest
from vacantia.plans.registry import query
from vacantia.plans.table_queries import rows

TEXT = "VARCHAR(200)"
FIELD = "CASE CAST(k % 9 AS INT) " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(payload.SALARY_FIELDS)) + " END"
AMOUNT = f"CAST(1000 + k % 90000 AS {TEXT})"
#: What the field holds, by key: objects, lists, bounds as texts, zeros, nothing, and what no bound can be read from.
VALUE = f"""CASE CAST(k % 14 AS INT)
 WHEN 0 THEN concat('{{"min": ', {AMOUNT}, ', "max": ', CAST(2000 + k % 90000 AS {TEXT}), ', "currency": "usd", "interval": "Year"}}')
 WHEN 1 THEN concat('[{{"min_amount": "', {AMOUNT}, '", "max_amount": "90000.5", "currency_code": "EUR", "unit": "HOUR"}}, {{"min": 1}}]')
 WHEN 2 THEN concat('{{"minimum": ', {AMOUNT}, ', "currencyCode": "gbp", "period": "fortnight"}}')
 WHEN 3 THEN '{{"min": 0, "max": 0, "minimum": 0, "maximum": 0}}'
 WHEN 4 THEN '{{"min": "negotiable", "max": "DOE"}}'
 WHEN 5 THEN 'null'
 WHEN 6 THEN '"80k - 90k"'
 WHEN 7 THEN '[]'
 WHEN 8 THEN concat('{{"min": 0, "min_amount": "", "minimum": null, "max": ', {AMOUNT}, ', "currency": ""}}')
 WHEN 9 THEN concat('{{"min": false, "max_amount": true, "currency": 978, "unit": "day"}}')
 WHEN 10 THEN concat('{{"min": " ', {AMOUNT}, '.25 ", "max": {{"value": 1}}}}')
 WHEN 11 THEN concat('{{"min": "1_000", "max": 2e3, "currency": "pln", "interval": null, "period": "month"}}')
 WHEN 12 THEN '["no object"]'
 ELSE '{{}}' END"""
#: A second field behind the first for some, and what is no payload at all for a few.
SECOND = """CASE WHEN k % 3 = 0 AND k % 9 < 8 THEN concat(', "salaryRange": {"min": 7, "max": ', CAST(k % 50 AS VARCHAR(200)), ', "currency": "EUR"}') ELSE '' END"""
PAYLOADS = """SELECT job_id, k, CASE WHEN k % 101 = 0 THEN '{"salary": ' WHEN k % 103 = 0 THEN '[1]' ELSE
 concat('{"id": ', CAST(k AS VARCHAR(200)), ', "', """ + FIELD + """, '": ', """ + VALUE + ", " + SECOND + """, '}') END AS payload FROM jobs_v"""

# The same by DuckDB's JSON functions.
_HOLDS = "({0} IS NOT NULL AND CAST({0} AS VARCHAR) NOT IN ('null', 'false', '\"\"', '[]', '{{}}') AND NOT (json_type({0}) IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND TRY_CAST(CAST({0} AS VARCHAR) AS DOUBLE) = 0))"
_NUM = "(CASE json_type({0}) WHEN 'VARCHAR' THEN TRY_CAST(replace(trim({0} ->> '$'), '_', '') AS DOUBLE) WHEN 'BOOLEAN' THEN CASE WHEN CAST({0} AS VARCHAR) = 'true' THEN 1e0 ELSE 0e0 END WHEN 'OBJECT' THEN NULL WHEN 'ARRAY' THEN NULL ELSE TRY_CAST(CAST({0} AS VARCHAR) AS DOUBLE) END)"


def _first(keys: tuple[str, ...]) -> str:
    parts = [f"json_extract(v, '$.{k}')" for k in keys]
    return "coalesce(" + ", ".join(f"CASE WHEN {_HOLDS.format(p)} THEN {p} END" for p in parts) + f", {parts[-1]})"


_RATES = "CASE cur " + " ".join(f"WHEN '{c}' THEN {r}e0" for c, r in EUROS.items()) + " END"
STRUCTURED = f"""
WITH p AS ({PAYLOADS}), f AS (SELECT job_id, unnest(range({len(payload.SALARY_FIELDS)})) AS n, unnest({list(payload.SALARY_FIELDS)}) AS name, CASE WHEN json_valid(payload) THEN payload END AS payload FROM p),
e AS (SELECT job_id, n, json_extract(payload, '$.' || name) AS v FROM f),
o AS (SELECT job_id, n, CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[0]') ELSE v END AS v FROM e),
b AS (SELECT job_id, n, {_first(payload.LOW)} AS lo, {_first(payload.HIGH)} AS hi, {_first(payload.CODE)} AS code, {_first(payload.PERIOD)} AS per FROM o WHERE json_type(v) = 'OBJECT'),
g AS (SELECT job_id, n, {_NUM.format("lo")} AS a, {_NUM.format("hi")} AS z, CASE json_type(code) WHEN 'VARCHAR' THEN upper(code ->> '$') WHEN 'NULL' THEN NULL ELSE CAST(code AS VARCHAR) END AS cur, lower(per ->> '$') AS per FROM b
  WHERE ({_HOLDS.format("lo")} OR {_HOLDS.format("hi")}) AND (lo IS NULL OR json_type(lo) = 'NULL' OR {_NUM.format("lo")} IS NOT NULL) AND (hi IS NULL OR json_type(hi) = 'NULL' OR {_NUM.format("hi")} IS NOT NULL)),
h AS (SELECT job_id, arg_min(struct_pack(a := a, z := z, cur := cur, per := per), n) AS s FROM g WHERE NOT coalesce(a = 0 AND z = 0, false) GROUP BY job_id)
SELECT job_id, s.a AS salary_min, s.z AS salary_max, s.cur AS salary_currency, CASE WHEN s IS NULL THEN NULL WHEN s.per IN ('hour', 'day', 'month', 'year') THEN s.per ELSE 'year' END AS salary_period,
  CASE WHEN s IS NOT NULL THEN 'structured' END AS salary_source, nullif(s.a, 0) * {_RATES.replace("CASE cur", "CASE s.cur")} AS salary_min_eur, nullif(s.z, 0) * {_RATES.replace("CASE cur", "CASE s.cur")} AS salary_max_eur
FROM p LEFT JOIN h USING (job_id)"""
query("n02_structured_salary", STRUCTURED, "jobs_v", rounded=("salary_min_eur", "salary_max_eur"))(
    lambda t: rows(t, PAYLOADS).select("job_id", payload.structured_salary(payload.variant(F.col("payload"))).alias("s")).select("job_id", "s.*")
)

#: Shapes of the landed values, as they are written down by hand.
SHAPES = {
    0: "{currency:str,interval:str,max:int,min:int}", 1: "list[{currency_code:str,max_amount:str,min_amount:str,unit:str},{min:int}]", 2: "{currencyCode:str,minimum:int,period:str}", 3: "{max:int,maximum:int,min:int,minimum:int}",
    4: "{max:str,min:str}", 5: "null", 6: "str", 7: "list[]", 8: "{currency:str,max:int,min:int,min_amount:str,minimum:null}", 9: "{currency:int,max_amount:bool,min:bool,unit:str}", 10: "{max:{value:int},min:str}",
    11: "{currency:str,interval:null,max:float,min:str,period:str}", 12: "list[str]", 13: "{}",
}
_SHAPE = "CASE CAST(k % 14 AS INT) " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in SHAPES.items()) + " END"
_PARTS = f"list_sort([concat('id', chr(0), 'int'), concat({FIELD}, chr(0), {_SHAPE})] || CASE WHEN k % 3 = 0 AND k % 9 < 8 THEN [concat('salaryRange', chr(0), '{{currency:str,max:int,min:int}}')] ELSE [] END)"
query("h04_shape_rows", f"SELECT job_id, CASE WHEN k % 101 = 0 THEN NULL WHEN k % 103 = 0 THEN sha256('list[int]') ELSE sha256(concat('{{', replace(array_to_string({_PARTS}, ','), chr(0), ':'), '}}')) END AS hash FROM jobs_v", "jobs_v")(
    lambda t: rows(t, PAYLOADS).select("job_id", payload.schema_hash(F.col("payload")).alias("hash"))
)

# Texts of the documents as they look when their UTF-8 is read as Latin-1, and back.
query("x08_repaired_rows", "SELECT doc_id, md5(text) AS hash FROM documents")(
    lambda t: t.read("documents").select("doc_id", F.md5(payload.repaired(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).cast("binary")).alias("hash"))
)

#: Postings on their whole way in: repair, spam, a structured salary before the text's, a trace of five steps or one.
LANDED = f"""SELECT j.job_id, j.k, p.payload, 'c-1' AS company_id, j.company_name, CASE WHEN j.k % 2 = 0 THEN 'Fully Remote Backend Engineer' ELSE 'Onsite Engineer' END AS title, CASE WHEN j.k % 4 < 2 THEN 'Spain' ELSE 'APAC' END AS remote_scope,
  CASE CAST(j.k % 5 AS INT) WHEN 0 THEN concat('<p>We work in Z', chr(195), chr(188), 'rich.</p>') WHEN 1 THEN '<p>Salary 50000 - 60000 EUR per year</p>' WHEN 2 THEN 'US only' ELSE concat('Build.', chr(10), 'Please mention the word CAT when applying', chr(10), 'Thanks') END AS description,
  CASE WHEN j.k % 3 = 0 THEN 'remoteok' ELSE 'greenhouse:acme' END AS source, CAST(NULL AS {TEXT}) AS department, CAST(3 AS INT) AS salary_min, CAST(NULL AS INT) AS salary_max, CAST(NULL AS {TEXT}) AS salary_currency, CAST(NULL AS {TEXT}) AS salary_period, 'ats_api' AS salary_source
FROM jobs_v j JOIN ({PAYLOADS}) p ON p.job_id = j.job_id"""
query("c13_process_rows", f"""
WITH s AS ({STRUCTURED}), l AS ({LANDED}),
d AS (SELECT l.job_id, l.k, title, source, remote_scope, CASE CAST(l.k % 5 AS INT) WHEN 0 THEN 'We work in Zürich.' WHEN 1 THEN 'Salary 50000 - 60000 EUR per year' WHEN 2 THEN 'US only' ELSE CASE WHEN source = 'remoteok' THEN 'Build.
Thanks' ELSE l.description END END AS description, s.salary_source AS told, s.salary_min AS a, s.salary_max AS z, l.k % 5 = 2 AS hard, l.k % 2 = 0 AS far, l.k % 4 < 2 AS near FROM l JOIN s ON s.job_id = l.job_id)
SELECT job_id, md5(description) AS description, CASE WHEN told IS NOT NULL THEN CAST(trunc(a) AS INTEGER) WHEN k % 5 = 1 THEN 50000 ELSE 3 END AS salary_min, CASE WHEN told IS NOT NULL THEN CAST(trunc(z) AS INTEGER) WHEN k % 5 = 1 THEN 60000 END AS salary_max,
  coalesce(told, 'ats_api') AS salary_source, CASE WHEN told IS NOT NULL OR k % 5 = 1 THEN 'disclosed' ELSE 'not_disclosed' END AS salary_transparency_status, CASE WHEN hard THEN 1 ELSE 5 END AS n_steps,
  CASE WHEN hard THEN 'true' WHEN far AND near THEN '' WHEN far THEN 'non_eu' WHEN near THEN 'non_remote' ELSE 'non_remote,non_eu' END AS against, hard AS hard_geo_flag
FROM d""", "jobs_v")(lambda t: _way_in(t))


def _way_in(t):
    done = ingest.process(ingest.spread(rows(t, LANDED.replace("chr(195), chr(188)", "'Ã', '¼'"))), "v1")
    told = ("description", "salary_min", "salary_max", "salary_source", "salary_transparency_status")
    # Both out of one row: a join of the postings' texts with their reports would process each posting twice.
    report = ingest.compliance_reports(done.withColumn("description", F.md5(F.col("description").cast("binary"))), *told)
    report = report.withColumn("v", F.from_json("decision_vector", "array<struct<step:string,result:string,penalties:array<string>>>"))
    scoring = F.get(F.filter("v", lambda s: s["step"] == "scoring"), 0)
    return report.select("job_id", *told, F.size("v").alias("n_steps"), F.coalesce(F.array_join(scoring["penalties"], ","), F.get("v", 0)["result"]).alias("against"), "hard_geo_flag")


query("k04_report_rows", f"""
WITH l AS (SELECT *, k % 5 = 2 AS hard, k % 2 = 0 AS far, k % 4 < 2 AS near FROM ({LANDED}))
SELECT job_id, sha256(concat_ws('|', 'c-1', lower(title), lower(remote_scope))) AS job_uid, 'v1' AS policy_version, CASE WHEN hard THEN 'unknown' WHEN far THEN 'remote_only' ELSE 'non_remote' END AS remote_class,
  CASE WHEN hard OR NOT near THEN 'non_eu' ELSE 'eu_member_state' END AS geo_class, hard AS hard_geo_flag, CAST(CASE WHEN far AND near AND NOT hard THEN 100 ELSE 0 END AS INTEGER) AS base_score, CAST(NULL AS VARCHAR) AS penalties, CAST(NULL AS VARCHAR) AS bonuses,
  CAST(CASE WHEN far AND near AND NOT hard THEN 100 ELSE 0 END AS INTEGER) AS final_score, CASE WHEN far AND near AND NOT hard THEN 'approved' ELSE 'rejected' END AS final_status, CASE WHEN hard THEN 'geo_restriction_hard' END AS policy_reason FROM l""", "jobs_v")(
    lambda t: ingest.compliance_reports(ingest.process(rows(t, LANDED.replace("chr(195), chr(188)", "'Ã', '¼'")), "v1")).drop("decision_vector")
)

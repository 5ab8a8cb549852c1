"""Decision and text rules over whole tables, with SQL twins that state each rule once more.

Postings get their words from a list by their keys, so every rule meets rows that it decides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.functions import classify as c
from vacantia.functions import text as x
from vacantia.plans.registry import query
from vacantia.plans.table_queries import rows


def chosen(values, key: str = "k") -> str:
    """SQL of one of the values by key, NULL for the rest of the division."""
    return f"CASE CAST({key} % {len(values) + 1} AS INT) " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def parts(column: str, phrases) -> str:
    """SQL: some phrase stands in the column."""
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


def words(column: str, phrases) -> str:
    """SQL: some phrase stands in the column between word bounds."""
    return rf"regexp_matches({column}, '\b(?:{'|'.join(phrases)})\b')"


def first_of(column: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {words(column, phrases)} THEN '{result}'" for phrases, result in rules) + " ELSE 'unknown' END"


TITLES = (
    "Senior Backend Engineer", "Remote-friendly Engineer", "Onsite Nurse", "Engineer (Fully Remote)", "Remote Site Reliability Engineer", "UX Designer", "Account Executive",
    "Data Scientist, ML", "Head of Talent", "DevOps Lead (AWS)", "Full Stack Developer", "CTO", "Product Manager", "Dev-Sec-Ops Intern", "Finance Operations Associate", "Front end developer",
)
DESCRIPTIONS = (
    "This role is based in Paris", "partially remote", "We are a fully distributed company", "we have distributed teams", "a work from home budget", "You work remotely from Spain",
    "flexible remote policy", "two days in office", "hybrid", "work from home", "The salary will be discussed later", "US only", "must be based in Asia-Pacific", "",
)
SCOPES = ("Remote - Poland", "Remote", "Fully remote", "Remote, worldwide", "Hybrid - Berlin", "remote friendly", "Spain (Remote)", "Spain", "home based - Poland", "EU Remote", " Remote   Europe ")
DEPARTMENTS = ("Data", "Marketing", "People and talent", "Office")

#: Postings with words; titles, descriptions, scopes and departments change at different steps.
POSTINGS = f"SELECT job_id, k, {chosen(TITLES)} AS title, {chosen(DESCRIPTIONS)} AS description, {chosen(SCOPES)} AS scope, {chosen(DEPARTMENTS)} AS department FROM jobs_v"
LOWERED = f"SELECT *, lower(coalesce(title, '')) AS t, lower(coalesce(description, '')) AS d, lower(coalesce(scope, '')) AS s FROM ({POSTINGS})"


def postings(t):
    return rows(t, POSTINGS)


query("c01_hard_geo_rows", f"SELECT job_id, {words('d', c.HARD)} AS hard_geo FROM ({LOWERED})", "jobs_v")(lambda t: postings(t).select("job_id", c.hard_geo(F.col("description")).alias("hard_geo")))

ALONE = "regexp_matches(d, '(^|[^a-z])(?:{})([^a-z]|$)')"
NOT_HOME = "|".join(p for p in c.REMOTE if p != "work from home")
query("c02_remote_rows", f"""
WITH p AS ({LOWERED}),
q AS (SELECT *, CASE {" ".join(f"WHEN contains(s, '{p}') THEN '{p}'" for p in c.REMOTE)} WHEN contains(s, 'remote') THEN 'remote' END AS word FROM p),
r AS (SELECT *, trim(replace(replace(replace(s, coalesce(word, ''), ''), '-', ''), ',', '')) AS rest FROM q),
v AS (SELECT job_id, CASE
  WHEN {parts('s', c.OFFICE + c.HYBRID)} THEN 'non_remote scope_negative_or_hybrid'
  WHEN {parts('t', c.OFFICE + c.HYBRID)} THEN 'non_remote title_negative_or_hybrid'
  WHEN {parts('t', c.OPTIONAL)} OR {parts('s', c.OPTIONAL)} THEN 'remote_optional title_or_scope_optional'
  WHEN word IS NOT NULL AND rest NOT IN ('', 'yes', 'true', '1', 'anywhere', 'worldwide') THEN 'remote_region_locked scope_region'
  WHEN word IS NOT NULL THEN 'remote_only scope_' || replace(word, ' ', '_')
  WHEN {parts('t', c.REMOTE)} THEN 'remote_only title_remote_strong'
  WHEN {parts('d', c.OFFICE)} THEN 'non_remote desc_negative'
  WHEN {parts('d', c.HYBRID)} THEN 'non_remote hybrid_signal'
  WHEN contains(t, 'remote') THEN 'remote_only title_remote'
  WHEN {ALONE.format(NOT_HOME)} OR ({ALONE.format('work from home')} AND NOT regexp_matches(d, '{c.BENEFIT}')) THEN 'remote_only desc_remote_strong'
  WHEN {parts('d', c.REGION_LOCKED)} THEN 'remote_region_locked desc_remote_region_locked'
  WHEN {parts('d', c.OPTIONAL)} THEN 'remote_optional benefit_remote'
  ELSE 'unknown no_signal' END AS v FROM r)
SELECT job_id, split_part(v, ' ', 1) AS remote_class, split_part(v, ' ', 2) AS remote_reason FROM v""", "jobs_v")(
    lambda t: postings(t).select("job_id", c.remote_model(F.col("title"), F.col("description"), F.col("scope")).alias("r")).select("job_id", "r.*")
)

query("c03_remote_simple_rows", f"""
WITH p AS (SELECT *, t || ' ' || d || ' ' || s AS a FROM ({LOWERED}))
SELECT job_id, CASE WHEN {parts('a', c.OFFICE)} THEN 'office_first' WHEN {parts('a', c.HYBRID)} THEN 'hybrid'
  WHEN contains(s, 'remote') AND trim(replace(replace(s, 'remote', ''), ',', '')) <> '' THEN 'remote_but_geo_restricted'
  WHEN {parts('a', c.REGION_LOCKED)} THEN 'remote_region_locked' WHEN {parts('a', c.REMOTE)} THEN 'remote_only' WHEN {parts('a', c.OPTIONAL)} THEN 'remote_optional' ELSE 'unknown' END AS remote_model FROM p""", "jobs_v")(
    lambda t: postings(t).select("job_id", c.remote_model_simple(F.col("title"), F.col("description"), F.col("scope"))["remote_model"].alias("remote_model"))
)

PLAIN = "t"
for source, target in c.SYNONYMS:
    PLAIN = rf"regexp_replace({PLAIN}, '\b{source}\b', '{target}', 'g')"
query("c09_taxonomy_rows", f"""
WITH p AS (SELECT *, lower(coalesce(department, '')) AS dep, {PLAIN} AS plain FROM ({LOWERED})),
f AS (SELECT *, coalesce(nullif({first_of('dep', c.FAMILIES)}, 'unknown'), {first_of('t', c.FAMILIES)}) AS job_family FROM p)
SELECT job_id, job_family, CASE job_family {" ".join(f"WHEN '{name}' THEN {first_of('t', rules)}" for name, rules in c.ROLES.items())} ELSE 'unknown' END AS job_role,
  {first_of('t', c.SENIORITIES)} AS seniority, {first_of('plain', c.SPECIALIZATIONS)} AS specialization FROM f""", "jobs_v")(
    lambda t: postings(t).select("job_id", c.taxonomy(F.col("title"), F.col("department")).alias("x")).select("job_id", "x.*")
)

query("c12_transparency_rows", f"SELECT job_id, CASE WHEN k % 2 = 0 THEN 'disclosed' WHEN d = '' THEN 'unknown' WHEN {parts('d', c.TRANSPARENCY)} THEN 'transparent_statement' ELSE 'not_disclosed' END AS status FROM ({LOWERED})", "jobs_v")(
    lambda t: postings(t).select("job_id", c.transparency(F.col("description"), F.col("k") % 2 == 0).alias("status"))
)
query("x14_detect_remote_rows", f"SELECT job_id, {words('a', x.REMOTE_WORDS)} AS is_remote, {words('a', x.PROBE_WORDS)} AS probed FROM (SELECT job_id, t || ' ' || s || ' ' AS a FROM ({LOWERED}))", "jobs_v")(
    lambda t: postings(t).select("job_id", x.detects_remote(F.col("title"), F.col("scope")).alias("is_remote"), x.detects_remote(F.col("title"), F.col("scope"), probe=True).alias("probed"))
)
query("x09_scope_rows", f"SELECT job_id, CASE trim(s) {' '.join(f'''WHEN '{name}' THEN '{kind}' ''' for name, kind in x.SCOPES.items())} ELSE trim(s) END AS scope FROM ({LOWERED})", "jobs_v")(lambda t: postings(t).select("job_id", x.canonical_scope(F.col("scope")).alias("scope")))
query("x12_location_rows", f"SELECT job_id, nullif(regexp_replace(trim(scope), '\\s+', ' ', 'g'), '') AS location FROM ({POSTINGS})", "jobs_v")(lambda t: postings(t).select("job_id", x.clean_location(F.col("scope")).alias("location")))
query("x13_description_rows", f"SELECT job_id, concat_ws(chr(10) || chr(10), nullif(trim(description), ''), '<h3>Where</h3>' || chr(10) || nullif(trim(scope), '')) AS description FROM ({POSTINGS})", "jobs_v")(
    lambda t: postings(t).select("job_id", x.described((F.col("description"), None), (F.col("scope"), "Where")).alias("description"))
)

# Money, points, names of classes.
MONEY = f"SELECT job_id, k, salary_min_eur AS amount, {chosen((*c.EUROS, 'usd', 'JPY'))} AS code, seniority, specialization, CAST(k % 4 AS INT) AS low, source FROM jobs_v"
query("m01_eur_rows", f"SELECT job_id, nullif(amount, 0) * CASE upper(code) {' '.join(f'''WHEN '{code}' THEN {rate!r}e0''' for code, rate in c.EUROS.items())} END AS eur FROM ({MONEY})", "jobs_v", rounded=("eur",))(
    lambda t: rows(t, MONEY).select("job_id", c.in_euros(F.col("amount"), F.col("code")).alias("eur"))
)
LEVELS = f"SELECT job_id, {chosen(('senior', 'manager', 'junior', 'executive'))} AS seniority, {chosen((*c.TECHNICAL, 'data', 'mobile'))} AS specialization, CAST(k % 4 AS INT) AS low, CASE WHEN k % 5 = 0 THEN 'greenhouse' ELSE source END AS source, CASE WHEN k % 3 = 0 THEN repeat('word ', 161) ELSE title END AS description FROM jobs_v"
query("m07_quality_rows", f"""
SELECT job_id, CASE seniority WHEN 'senior' THEN 25 WHEN 'manager' THEN 20 WHEN 'junior' THEN 5 ELSE 0 END + CASE WHEN specialization IS NULL OR specialization IN ('data', 'mobile') THEN 0 ELSE 20 END
  + CASE WHEN low > 0 THEN 15 ELSE 0 END + CASE WHEN length(description) > 800 THEN 10 ELSE 0 END + CASE WHEN source = 'greenhouse' THEN 5 ELSE 0 END AS score FROM ({LEVELS})""", "jobs_v")(
    lambda t: rows(t, LEVELS).select("job_id", c.quality_score(F.col("seniority"), F.col("specialization"), F.col("description"), F.col("low"), F.col("source")).alias("score"))
)
NAMED = f"SELECT job_id, {chosen((*c.OLD_REMOTE, ' Remote_Only ', 'NON_REMOTE', 'sometimes'))} AS remote, {chosen((*c.OLD_GEO, ' EU_Region', 'UK', 'moon'))} AS geo FROM jobs_v"
query("c08_class_name_rows", f"""
SELECT job_id, CASE lower(trim(remote)) WHEN 'remote_but_geo_restricted' THEN 'remote_region_locked' WHEN 'hybrid' THEN 'non_remote' WHEN 'office_first' THEN 'non_remote' WHEN 'remote_only' THEN 'remote_only' WHEN 'non_remote' THEN 'non_remote' ELSE 'unknown' END AS remote_class,
  CASE lower(trim(geo)) WHEN 'eog' THEN 'eu_region' WHEN 'eu_region' THEN 'eu_region' WHEN 'uk' THEN 'uk' WHEN 'non_eu_restricted' THEN 'non_eu' ELSE 'unknown' END AS geo_class FROM ({NAMED})""", "jobs_v")(
    lambda t: rows(t, NAMED).select("job_id", c.remote_class_name(F.col("remote")).alias("remote_class"), c.geo_class_name(F.col("geo")).alias("geo_class"))
)

# Whole texts and names.
query("c11_currency_rows", "SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{mark}') THEN '{code}'" for mark, code in c.CURRENCY_MARKS.items()) + " END AS currency FROM documents")(
    lambda t: t.read("documents").select("doc_id", c.currency(F.col("text")).alias("currency"))
)
NOISE = "Please mention the word CAT7 when applying today"
query("x07_spam_rows", rf"""
SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'please mention the word\s+[a-z0-9]+\s+(?:when applying|in your application)[^\n]*\n?', '', 'gi'),
  '(?:this is a\s+)?beta feature to avoid spam[^\n]*\n?', '', 'gi'), 'rmtg[-a-z0-9+/]+={{0,2}}\s*\n?', '', 'gi'), '<img[^>]+src=["''][^"'']*tracking[^"'']*["''][^>]*>', '', 'gi') ELSE text END) AS text_md5
FROM (SELECT doc_id, text || chr(10) || '{NOISE}' || chr(10) || 'RMTGabc+/==' || chr(10) || text AS text FROM documents)""")(
    lambda t: t.read("documents")
    .select("doc_id", F.concat_ws("\n", "text", F.lit(NOISE), F.lit("RMTGabc+/=="), "text").alias("text"), F.col("text").isNotNull().alias("has"))
    .select("doc_id", F.md5(F.when(F.col("has"), x.without_spam(F.col("text"), F.when(F.col("doc_id") % 2 == 0, "remoteok").otherwise("lever"))).cast("binary")).alias("text_md5"))
)
query("x15_slug_name_rows", "SELECT company_ats_id, upper(left(ats_slug, 1)) || substr(replace(ats_slug, '-', ' '), 2) AS name FROM company_ats_v")(lambda t: t.company_ats.select("company_ats_id", x.title_from_slug(F.col("ats_slug")).alias("name")))
TIMES = "SELECT job_id, k, first_seen_at FROM jobs_v"
query("d1_date_rows", f"SELECT job_id, CASE WHEN k % 6 < 5 THEN strftime(first_seen_at, '%Y-%m-%d %H:%M:%S') END AS utc FROM ({TIMES})", "jobs_v")(
    lambda t: rows(t, TIMES)
    .withColumn("day", F.date_format("first_seen_at", "yyyy-MM-dd"))
    .withColumn("value", F.when(F.col("k") % 6 == 0, F.concat("day", F.lit("T00:00:00Z"))).when(F.col("k") % 6 == 1, F.concat("day", F.lit("T02:00:00+02:00"))).when(F.col("k") % 6 == 2, F.col("day"))
                .when(F.col("k") % 6 == 3, F.concat(F.date_format("first_seen_at", "EEE, d MMM yyyy"), F.lit(" 00:00:00 +0000"))).when(F.col("k") % 6 == 4, F.concat(F.lit(" "), "day", F.lit(" "))).otherwise("soon"))
    .select("job_id", F.date_format(F.to_utc_timestamp(x.moment(F.col("value")), F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("utc"))
)
PAY = "SELECT job_id, CASE WHEN k % 3 > 0 THEN CAST(k AS VARCHAR(20)) END AS low, CASE WHEN k % 4 > 1 THEN concat(CAST(k AS VARCHAR(20)), '.9') END AS high, CASE CAST(k % 5 AS INT) WHEN 0 THEN 'Yearly' WHEN 1 THEN 'per month' WHEN 2 THEN 'HOUR' WHEN 3 THEN 'annual' END AS unit FROM jobs_v"
query("n01_ats_salary_rows", f"""
SELECT job_id, CAST(low AS INTEGER) AS salary_min, CAST(split_part(high, '.', 1) AS INTEGER) AS salary_max, CASE unit WHEN 'Yearly' THEN 'yearly' WHEN 'annual' THEN 'yearly' WHEN 'per month' THEN 'monthly' WHEN 'HOUR' THEN 'hourly' END AS salary_period,
  CASE WHEN low IS NOT NULL OR high IS NOT NULL THEN 'ats_api' END AS salary_source FROM ({PAY})""", "jobs_v")(
    lambda t: rows(t, PAY).select("job_id", c.ats_salary(F.create_map(F.lit("min_value"), F.col("low"), F.lit("max"), F.col("high"), F.lit("period"), F.col("unit"))).alias("s")).select("job_id", *[f"s.{n}" for n in ("salary_min", "salary_max", "salary_period", "salary_source")])
)

"""Text functions over documents, pages and addresses, and decision rules over known cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.functions import classify as c
from vacantia.functions import text as x
from vacantia.functions.columns import trigram_distance
from vacantia.plans.bindings import Tables
from vacantia.plans.registry import query
from vacantia.plans.search_queries import distance

NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\x{{A0}}]+', ' ', 'g'))"


def docs(t: Tables):
    return t.read("documents")


query("x01_normalise", f"SELECT doc_id, md5({NORM.format('text')}) AS text_md5 FROM documents")(lambda t: docs(t).select("doc_id", F.md5(x.normalise(F.col("text")).cast("binary")).alias("text_md5")))
query("x02_company_names", f"SELECT DISTINCT {NORM.format('c_name')} AS name FROM customer")(lambda t: t.read("customer").select(x.normalise(F.col("c_name")).alias("name")).distinct())
query("x03_trigram", f"SELECT l_name, CAST({distance('l_name', "'customer 1'")} AS DOUBLE) AS distance FROM (SELECT replace(legal_name, '#', ' ') AS l_name FROM companies_v)")(
    lambda t: t.companies.select(F.replace("legal_name", F.lit("#"), F.lit(" ")).alias("l_name")).select("l_name", trigram_distance(F.col("l_name"), F.lit("customer 1")).alias("distance"))
)
query("x05_whitespace", """
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), '[ \\t]+\\n', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+', ''), '\\s+$', '')) AS text_md5
FROM documents""")(lambda t: docs(t).select("doc_id", F.md5(x.whitespace(F.col("text")).cast("binary")).alias("text_md5")))
query("x11_sanitize_url", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', ['s', 'h', 'p', 'q']) AS u FROM (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN '&utm_source=x&gclid=1#frag' ELSE '' END AS url FROM pages)),
k AS (SELECT page_id, u, array_to_string(list_filter(string_split(u.q, '&'), lambda a: a <> '' AND NOT starts_with(lower(split_part(a, '=', 1)), 'utm_') AND lower(split_part(a, '=', 1)) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid')), '&') AS q FROM p)
SELECT page_id, lower(u.s) || '://' || lower(u.h) || u.p || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url FROM k""")(
    lambda t: t.read("pages").select("page_id", x.clean_url(F.concat("url", F.when(F.col("page_id") % 3 == 0, "&utm_source=x&gclid=1#frag").otherwise(""))).alias("url"))
)
query("h01_uid", f"SELECT doc_id, sha256(concat_ws('|', CAST(doc_id AS VARCHAR), {NORM.format('text')}, {NORM.format('source')})) AS job_uid FROM documents")(lambda t: docs(t).select("doc_id", x.job_uid(F.col("doc_id"), F.col("text"), F.col("source")).alias("job_uid")))
CUT = "substr({0}, 1, {1})"
#: A title for each document.
LABEL = "(lang || '  ' || source)"
query("h02_fingerprint", f"""
SELECT doc_id, md5(concat_ws('|', {NORM.format('source')}, {NORM.format('lang')}, {NORM.format(LABEL)}, '', substr({NORM.format("substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 1500)")}, 1, 500))) AS job_fingerprint FROM documents""")(
    lambda t: docs(t).select("doc_id", x.job_fingerprint(F.col("source"), F.col("lang"), F.concat("lang", F.lit("  "), "source"), F.lit(None), F.col("text")).alias("job_fingerprint"))
)
query("h03_canonical", f"""
SELECT doc_id, sha1(concat_ws('|', {NORM.format('source')}, {NORM.format(LABEL)}, substr({NORM.format("substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 3000)")}, 1, 1000))) AS canonical_id FROM documents""")(
    lambda t: docs(t).select("doc_id", x.canonical_job_id(F.col("source"), F.concat("lang", F.lit("  "), "source"), F.col("text")).alias("canonical_id"))
)
query("a25_leftover_tags", "SELECT tag, count(*) AS n FROM (SELECT unnest(list_transform(regexp_extract_all(html, '</?([a-zA-Z][a-zA-Z0-9]*)[^>]*>', 1), lambda g: lower(g))) AS tag FROM pages) GROUP BY tag ORDER BY n DESC, tag LIMIT 5")(
    lambda t: t.read("pages").select(F.explode(x.leftover_tags(F.col("html"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(5)
)
query("x04_html_to_markdown")(lambda t: t.read("pages").select("page_id", x.clean_description(F.col("html")).alias("markdown")))
query("c06_matrix", """
SELECT job_id, CASE WHEN lower(remote_class) = 'non_remote' OR lower(geo_class) = 'non_eu' THEN 0 WHEN geo_class IN ('eu_member_state', 'eu_explicit', 'eu_region', 'uk') THEN
   CASE coalesce(remote_class, 'unknown') WHEN 'remote_only' THEN 100 WHEN 'remote_region_locked' THEN 90 WHEN 'remote_optional' THEN 60 ELSE 55 END ELSE 20 END AS compliance_score,
  CASE WHEN lower(remote_class) = 'non_remote' OR lower(geo_class) = 'non_eu' THEN 'rejected' WHEN geo_class IN ('eu_member_state', 'eu_explicit', 'eu_region', 'uk') THEN
   CASE WHEN remote_class IN ('remote_only', 'remote_region_locked') THEN 'approved' ELSE 'review' END ELSE 'rejected' END AS compliance_status
FROM jobs_v""")(lambda t: t.jobs.select("job_id", c.resolution(F.col("remote_class"), F.col("geo_class")).alias("r")).select("job_id", "r.*"))


def cases(name: str, columns: str, rows: list[tuple], expression, results: str):
    """A query over known cases (inputs, then expected results), with the expected rows as its oracle."""
    names, out = columns.split(), results.split()
    width = len(names)
    quote = lambda v: "NULL" if v is None else "true" if v is True else "false" if v is False else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    values = ", ".join("(" + ", ".join(map(quote, (i, *r[width:]))) + ")" for i, r in enumerate(rows))
    query(name, f"SELECT CAST(n AS INTEGER) AS n, {', '.join(out)} FROM (VALUES {values}) v(n, {', '.join(out)})")(
        lambda t: t.spark.createDataFrame([(i, *r[:width]) for i, r in enumerate(rows)], "n int, " + ", ".join(f"{n} string" for n in names)).select("n", *expression(*[F.col(n) for n in names]))
    )


cases("c01_hard_geo", "text", [
    ("Engineer, US only", True), ("You must be based in the US.", True), ("Green card required", True), ("Canada only please", True), ("We hire within APAC only", True),
    ("must reside in Asia-Pacific", True), ("based remotely in the APAC region", True), ("bus only lane", False), ("Remote in Europe", False), ("", False), (None, False), ("INDIA ONLY", True),
], lambda a: [c.hard_geo(a).alias("hard_geo")], "hard_geo")
cases("c02_remote", "title description scope", [
    ("Backend Engineer", "", "Hybrid - Berlin", "non_remote", "scope_negative_or_hybrid"),
    ("Onsite Nurse", "fully remote", "", "non_remote", "title_negative_or_hybrid"),
    ("Remote-friendly Engineer", "", "", "remote_optional", "title_or_scope_optional"),
    ("Engineer", "", "Remote - Poland", "remote_region_locked", "scope_region"),
    ("Engineer", "", "Remote", "remote_only", "scope_remote"),
    ("Engineer", "", "Fully remote", "remote_only", "scope_fully_remote"),
    ("Engineer", "", "Remote, worldwide", "remote_only", "scope_remote"),
    ("Engineer (Fully Remote)", "", "", "remote_only", "title_remote_strong"),
    ("Engineer", "This role is based in Paris", "", "non_remote", "desc_negative"),
    ("Remote Engineer", "partially remote", "", "non_remote", "hybrid_signal"),
    ("Remote Engineer", "two days in office", "", "non_remote", "desc_negative"),
    ("Remote Engineer", "", "", "remote_only", "title_remote"),
    ("Engineer", "We are a fully distributed company", "", "remote_only", "desc_remote_strong"),
    ("Engineer", "we have distributed teams", "", "unknown", "no_signal"),
    ("Engineer", "a work from home budget", "", "unknown", "no_signal"),
    ("Engineer", "You work remotely from Spain", "", "remote_region_locked", "desc_remote_region_locked"),
    ("Engineer", "flexible remote policy", "", "remote_optional", "benefit_remote"),
    (None, None, None, "unknown", "no_signal"),
], lambda a, b, d: [F.inline(F.array(c.remote_model(a, b, d)))], "remote_class remote_reason")
cases("c03_remote_simple", "title description scope", [
    ("Engineer", "on-site work", "", "office_first", 0.95), ("Engineer", "", "hybrid", "hybrid", 0.85), ("Engineer", "", "Remote, Spain", "remote_but_geo_restricted", 0.8), ("Engineer", "based remotely", "", "remote_region_locked", 0.85),
    ("Engineer", "fully remote", "", "remote_only", 0.9), ("Engineer", "remote friendly", "Remote", "remote_optional", 0.7), ("Engineer", "", "", "unknown", 0.3),
], lambda a, b, d: [c.remote_model_simple(a, b, d)["remote_model"].alias("remote_model"), c.remote_model_simple(a, b, d)["confidence"].alias("confidence")], "remote_model confidence")
TAX = "job_family job_role seniority specialization"
cases("c09_taxonomy", "title department", [
    ("Senior Backend Engineer", None, "software_development", "engineer", "senior", "backend"),
    ("Junior Frontend Developer", None, "software_development", "developer", "junior", "frontend"),
    ("Site Reliability Engineer", None, "software_development", "engineer", "unknown", "sre"),
    ("Full Stack Developer", None, "software_development", "developer", "unknown", "fullstack"),
    ("Product Manager", None, "product_management", "product_manager", "manager", "unknown"),
    ("UX Designer", None, "design", "designer", "unknown", "unknown"),
    ("Account Executive", None, "sales", "sales_representative", "unknown", "unknown"),
    ("Data Scientist, ML", None, "data_science", "data_scientist", "unknown", "machine_learning"),
    ("Analyst", "Data", "data_science", "data_scientist", "unknown", "unknown"),
    ("Engineer", "Marketing", "marketing", "unknown", "unknown", "unknown"),
    ("Head of Talent", None, "hr", "unknown", "manager", "unknown"),
    ("DevOps Lead (AWS)", None, "unknown", "unknown", "senior", "devops"),
    ("CTO", None, "unknown", "unknown", "executive", "unknown"),
    ("Internal Auditor", None, "unknown", "unknown", "unknown", "unknown"),
], lambda a, b: [c.taxonomy(a, b)[k].alias(k) for k in TAX.split()], TAX)
cases("c11_currency", "text", [("€50k", "EUR"), ("an entrepreneur", "EUR"), ("$100", "USD"), ("100 złoty", "PLN"), ("50 CHF", "CHF"), ("nothing", None), ("", None), (None, None)], lambda a: [c.currency(a).alias("currency")], "currency")
cases("c12_transparency", "description detected", [("x", "true", "disclosed"), ("", "false", "unknown"), (None, "false", "unknown"), ("The salary will be discussed later", "false", "transparent_statement"), ("We build", "false", "not_disclosed")], lambda a, b: [c.transparency(a, b.cast("boolean")).alias("status")], "status")
cases("m01_eur", "amount currency", [("100", "EUR", 100.0), ("100", "usd", 92.0), ("0", "EUR", None), ("100", "JPY", None), (None, "EUR", None), ("1000", "HUF", 2.5)], lambda a, b: [F.round(c.in_euros(a, b), 6).alias("eur")], "eur")
cases("m07_quality", "seniority specialization salary", [("senior", "backend", "50000", 60), ("manager", "data", None, 20), ("junior", "sre", "0", 25), (None, None, None, 0)], lambda a, b, d: [c.quality_score(a, b, F.lit(""), d.cast("int"), F.lit("greenhouse:acme")).alias("score")], "score")
cases("x09_scope", "value", [("Remote - Europe", "europe"), (" EU Remote ", "europe"), ("Remote Worldwide", "worldwide"), ("Berlin", "berlin"), (None, "")], lambda a: [x.canonical_scope(a).alias("scope")], "scope")
cases("x12_location", "value", [("  Warsaw ,\n Poland ", "Warsaw , Poland"), ("   ", None), (None, None)], lambda a: [x.clean_location(a).alias("location")], "location")
cases("x13_description", "a b", [("Hello", "World", "Hello\n\n<h3>More</h3>\nWorld"), ("  ", "World", "<h3>More</h3>\nWorld"), (None, None, "")], lambda a, b: [x.described((a, None), (b, "More")).alias("description")], "description")
cases("x14_detect_remote", "title location", [("Engineer", "Fully Remote", True), ("Engineer", "Remote", False), ("Work from home agent", None, True), ("Engineer", "Remoteland", False)], lambda a, b: [x.detects_remote(a, b).alias("is_remote")], "is_remote")
cases("x15_slug_name", "slug", [("acme-corp", "Acme Corp"), ("big_data-co", "Big Data Co")], lambda a: [x.title_from_slug(a).alias("name")], "name")
cases("d1_dates", "value", [
    ("2024-05-01T10:00:00Z", "2024-05-01 10:00:00"), ("2024-05-01T10:00:00+02:00", "2024-05-01 08:00:00"), ("2024-05-01", "2024-05-01 00:00:00"), ("Wed, 01 May 2024 10:00:00 +0000", "2024-05-01 10:00:00"),
    ("1714557600", "2024-05-01 10:00:00"), ("1714557600000", "2024-05-01 10:00:00"), ("soon", None), ("", None), (None, None),
], lambda a: [F.date_format(F.to_utc_timestamp(x.moment(a), F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("utc")], "utc")
cases("n01_ats_salary", "low high unit", [("50000", "60000.9", "Yearly", 50000, 60000, "yearly", "ats_api"), ("30", None, "per hour", 30, None, "hourly", "ats_api"), (None, None, "month", None, None, "monthly", None)],
      lambda a, b, d: (lambda s: [s[k].alias(k) for k in ("salary_min", "salary_max", "salary_period", "salary_source")])(c.ats_salary(F.create_map(F.lit("minAmount"), a, F.lit("max"), b, F.lit("interval"), d, F.lit("currency"), F.lit("eur")))), "salary_min salary_max salary_period salary_source")
cases("x04_markdown_cases", "html", [
    ("<p>Hello <b>World</b></p><ul><li>One</li><li>Two</li></ul>", "Hello World\n\n- One\n- Two"), ("<h2>Title</h2><p>A &amp; B</p>", "## Title\n\nA & B"), ("<script>x()</script>Text<br/>more", "Text\nmore"),
    ("<p>&nbsp;</p><div>In <em>it</em></div>", "In _it_"), ("A &#8364; &#x20AC; &lt;", "A € € <"), ("<hr>x", "---\nx"), ("", ""), (None, None),
], lambda a: [x.clean_description(a).alias("markdown")], "markdown")

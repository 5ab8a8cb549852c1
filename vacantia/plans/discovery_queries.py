"""Discovery rules, salaries, exports and streams over known cases and the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.functions.salary import text_salary
from vacantia.operators import state
from vacantia.plans import exports
from vacantia.plans.bindings import AS_OF
from vacantia.plans.market_queries import segments, series
from vacantia.plans.registry import query
from vacantia.plans.text_queries import cases
from vacantia.operators.market import active_counts
from vacantia.sources import discovery as d
from vacantia.streaming import keyed_state, tick

cases("c10_salary", "title description", [
    (None, "Salary: €80k–€100k per year", 80000, 100000, "EUR", "year"), (None, "Compensation range: $120k-$150k", 120000, 150000, "USD", "year"),
    (None, "Poland Pay Range 9 500 zł — 11 000 zł PLN", 9500, 11000, "PLN", "month"), (None, "Wynagrodzenie: 15 000 - 20 000 PLN / month", 15000, 20000, "PLN", "month"),
    (None, "Rate: 50 EUR / hour", 50, 50, "EUR", "hour"), (None, "Join a team of 30 engineers. Salary 90k-110k.", 90000, 110000, None, "year"),
    (None, "We are looking for a developer with 5-10 years of experience.", None, None, None, None), (None, "Our company has over 50000 users worldwide.", None, None, None, None),
    (None, "We just raised $50M in funding.", None, None, None, None), ("Senior Backend Engineer – €90k–€110k", "Join our amazing team!", 90000, 110000, "EUR", "year"),
    (None, "Base pay: 120k", 120000, 120000, None, "year"), (None, "17–23K PLN or 4,5-6k USD net on B2B", 17000, 23000, "PLN", "month"),
    (None, "100k - 120k USD lub 90k - 110k EUR", 100000, 120000, "USD", "year"), (None, "Base salary £70,000 - £90,000 / $90,000 - $115,000", 70000, 90000, "GBP", "year"), (None, None, None, None, None, None),
], lambda a, b: [text_salary(a, b)[k].alias(k) for k in ("salary_min", "salary_max", "salary_currency", "salary_period")], "salary_min salary_max salary_currency salary_period")
cases("s18_url_slug", "url provider", [
    ("https://acme.jobs.personio.com/x", "personio", "acme"), ("https://app.jobadder.com/jobboard/abc-1/", "jobadder", "abc-1"), ("https://app.jobadder.com/x/abc", "jobadder", None), ("https://jobs.lever.co/acme/1", "lever", "acme"),
    ("https://jobs.lever.co/", "lever", None), ("nonsense", "lever", None), ("https://x.example.com/a", "other", None),
], lambda a, b: [d.slug_of_address(a, b).alias("slug")], "slug")
cases("s20_careers_board", "redirect page", [
    ("https://jobs.lever.co/acme", "", "lever", "acme"), ("", '<a href="https://boards.greenhouse.io/embed/job_board?for=big">', "greenhouse", "big"), ("", "see https://x1.recruitee.com/o", "recruitee", "x1"), ("", "nothing", None, None),
], lambda a, b: [d.board_of_page(a, b)["provider"].alias("provider"), d.board_of_page(a, b)["slug"].alias("slug")], "provider slug")
cases("s23_slug_guesses", "name", [
    ("Acme Inc.", "acme,acmehq,acme-hq,acmeinc,acme-inc,acmelabs"), ("Big Data Ltd", "big-data,bigdata,big-datahq,big-data-hq,bigdatahq,bigdata-hq"), ("", ""), (None, ""), ("Group", "group,grouphq,group-hq,groupinc,group-inc,grouplabs"),
], lambda a: [F.array_join(F.slice(d.guesses(a), 1, 6), ",").alias("first")], "first")
cases("f22_valid_slug", "slug", [("acme", True), ("ab", False), ("demo-co", False), ("my-careers", False), ("  x ", False)], lambda a: [d.valid_slug(a).alias("ok")], "ok")
cases("d13_promotion", "provider passed token", [("lever", "true", "false", "promoted"), ("lever", "false", "true", "rejected"), ("teamtailor", "true", "false", "needs_token"), ("teamtailor", "true", "true", "promoted")], lambda a, b, c: [d.promotion(a, b.cast("boolean"), c.cast("boolean")).alias("status")], "status")
cases("f21_quality_gate", "total remote recent", [("3", "1", "2001-07-01", True), ("3", "0", "2001-07-01", False), ("0", "0", None, False), ("3", "1", "2000-01-01", False), ("3", "1", None, True)], lambda a, b, c: [d.passes_gate(a.cast("int"), b.cast("int"), c.cast("timestamp_ntz"), AS_OF).alias("ok")], "ok")

query("s19_certificate_slugs", "SELECT unnest(['acme', 'big-co']) AS slug")(lambda t: d.certificate_slugs(t.spark.createDataFrame([("*.acme.recruitee.com\nwww.recruitee.com",), ("big-co.recruitee.com\n\nA.recruitee.com",), (None,), ("acme.recruitee.com",)], "name_value string")))
query("s21_slug_harvest", "SELECT 'traffit' AS provider, 'acme' AS slug, 3 AS score UNION ALL SELECT 'breezy', 'solo', 2")(
    lambda t: d.harvest(t.spark.createDataFrame([("https://acme.traffit.com/x https://once.traffit.com", "html"), ("https://acme.traffit.com", "final_url"), ("https://solo.breezy.hr/p", "final_url"), ("https://www.teamtailor.com/jobs https://demo-x.breezy.hr", "final_url")], "text string, evidence string"))
)
query("s22_slug_list", "SELECT unnest(['acme', 'known', 'zeta']) AS slug")(lambda t: d.listed_slugs(t.spark.createDataFrame([(" zeta ",), ("# no",), ("",), ("acme",), ("acme",)], "value string"), t.spark.createDataFrame([("known",)], "slug string")))

FEED = "SELECT * FROM jobs_v WHERE status IN ('new', 'active') AND compliance_score >= 80 ORDER BY first_seen_at DESC NULLS FIRST, job_id LIMIT 200"
query("a19_feed_meta", f"SELECT count(*) AS count, min(nullif(salary_min_eur, 0)) AS salary_min, max(nullif(salary_min_eur, 0)) AS salary_max FROM ({FEED})")(lambda t: exports.feed_meta(exports.feed_jobs(t.jobs)))
query("a19_feed_departments", f"SELECT job_family AS name, count(*) AS count FROM ({FEED}) WHERE job_family IS NOT NULL AND job_family <> 'unknown' GROUP BY 1")(lambda t: exports.feed_departments(exports.feed_jobs(t.jobs)))
query("k11_feed_json")(lambda t: exports.feed_json(t.jobs))
query("k12_stats_json")(lambda t: exports.stats_json(series(t), active_counts(t.jobs)))
query("k13_segments_json")(lambda t: exports.segments_json(segments(t)))
query("st02_daily_window", "SELECT CAST(ts AS DATE) AS day, event_type AS kind, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1, 2", rounded=("mean",))(lambda t: tick.daily_windows(t.read("events").withColumn("ts", F.col("ts").cast("timestamp"))))


SOURCE_KEYS = ["source", "source_job_id"]


def stream(t):
    """Sources of jobs arrive in three files, and the stream is stopped and started again between them: its state,
    of which each batch rewrites only the buckets it touches, is what one merge would give. A landing may be several
    files, whose sightings of one source come in any order."""
    folder = tick.shared_folder(t.spark, "tick")
    rows = t.job_sources
    merge = lambda before, batch: state.merged_sources(before, batch, F.col("last_seen_at"), late=True)
    start = merge(rows.limit(0), rows.filter("seen_count = 1"))
    for k in range(3):
        # Each run makes its state anew from the folder, as a restarted driver would.
        table = keyed_state.KeyedState(t.spark, f"{folder}/state", start.schema, SOURCE_KEYS, n_buckets=16)
        table.merge(start, lambda old, new: new.select(*old.columns))
        rows.filter((F.col("seen_count") > 1) & (F.col("seen_count") % 3 == k)).write.parquet(f"{folder}/landed/part{k}")
        keyed_state.ingest_stream(t.spark, f"{folder}/landed/*", rows.schema, table, merge, f"{folder}/checkpoint")
    return table.read()


def stream_with_cursors(t):
    """Boards hand over everything again with each of three files, and one of them fails in the second file: with a cursor
    per board only what changed since then counts as a new sighting, and a failure leaves the board's cursor where it was."""
    folder = tick.shared_folder(t.spark, "cursors")
    rows = t.job_sources.withColumn("error", F.lit(None).cast("string"))
    year = F.year("last_seen_at")
    merge = lambda before, batch: state.merged_sources(before, batch.drop("error"), F.struct("last_seen_at", "job_id"))
    start = state.merged_sources(t.job_sources.limit(0), t.job_sources.limit(0))
    table = keyed_state.KeyedState(t.spark, f"{folder}/state", start.schema, SOURCE_KEYS, n_buckets=16)
    cursors = keyed_state.KeyedState(t.spark, f"{folder}/boards", t.spark.createDataFrame([], keyed_state.CURSORS).schema, ["board"], n_buckets=4)
    for k, last in enumerate((1994, 1996, 2100)):
        landed = rows.filter(year <= last)
        if k == 1:
            landed = landed.filter("source <> 'src3'").union(rows.limit(1).withColumns({"source": F.lit("src3"), "error": F.lit("fetch_failed")}))
        landed.coalesce(1).write.parquet(f"{folder}/landed/part{k}")
        keyed_state.ingest_stream(t.spark, f"{folder}/landed/*", rows.schema, table, merge, f"{folder}/checkpoint", cursors, error="error")
    return table.read().join(cursors.read(), F.col("source") == F.col("board")).drop("board")


LATEST = "(SELECT source, max(CASE WHEN extract(year FROM last_seen_at) <= 1994 THEN last_seen_at END) AS a, max(CASE WHEN extract(year FROM last_seen_at) <= 1996 THEN last_seen_at END) AS b, max(last_seen_at) AS c FROM job_sources_v GROUP BY source)"
query("st01_board_cursors", f"""
WITH s AS (SELECT j.*, extract(year FROM last_seen_at) AS y, l.a, CASE WHEN j.source = 'src3' THEN l.a ELSE l.b END AS b, l.c FROM job_sources_v j JOIN {LATEST} l ON l.source = j.source),
n AS (SELECT *, CASE WHEN y <= 1994 THEN 1 ELSE 0 END + CASE WHEN y <= 1996 AND source <> 'src3' AND last_seen_at >= coalesce(a, last_seen_at) THEN 1 ELSE 0 END + CASE WHEN last_seen_at >= coalesce(b, last_seen_at) THEN 1 ELSE 0 END AS m FROM s)
SELECT source, source_job_id, arg_max(job_id, struct_pack(x := last_seen_at, y := job_id)) AS job_id, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at, CAST(sum(m) AS INTEGER) AS seen_count, max(c) AS since
FROM n WHERE m > 0 GROUP BY source, source_job_id""", "job_sources_v")(stream_with_cursors)


query("st01_incremental_tick", "SELECT source, source_job_id, min(job_id) AS job_id, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at, CAST(count(*) AS INTEGER) AS seen_count FROM job_sources_v GROUP BY source, source_job_id")(stream)
query("s17_company_pages", "SELECT 'Acme' AS name, 'https://acme.example.com' AS url")(lambda t: d.companies_of_pages(t.spark.createDataFrame([("---\ntitle: \"Acme\"\nwebsite: https://acme.example.com\n---\nText",), ("title: only",), ("",)], "value string")))

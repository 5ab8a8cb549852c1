"""Responses that fetchers have landed, read through the data source: pages, details, errors; zips of company pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.plans import ingest
from vacantia.plans.registry import query
from vacantia.plans.table_queries import rows
from vacantia.sources import archives, boards, discovery, landed
from vacantia.streaming.tick import shared_folder

#: Jobs as postings of boards: three providers, five boards each, of which the last of each can't be read.
POSTED = """SELECT k, job_id, CASE CAST(k % 3 AS INT) WHEN 0 THEN 'workable' WHEN 1 THEN 'smartrecruiters' ELSE 'jobadder' END AS provider, concat('board-', CAST(CAST(floor(k / 3) AS BIGINT) % 5 AS VARCHAR(5))) AS slug,
  CAST(CAST(floor(k / 15) AS BIGINT) % 4 AS INT) AS page, title FROM jobs_v"""
FAILS = "slug = 'board-4'"
#: Postings of a page stand in responses of no more than so many each, so that no response grows with the tables.
RESPONSE = 1000
#: Details of a seventh are missing, and jobadder has none.
DETAILED = "provider <> 'jobadder' AND k % 7 <> 0"


def _land(t, folder: str) -> None:
    posted = rows(t, POSTED)
    own = F.when(F.col("provider") == "workable", F.to_json(F.struct(F.col("job_id").alias("shortcode"), "title", F.lit("summary").alias("description"))))
    own = own.when(F.col("provider") == "smartrecruiters", F.to_json(F.struct(F.col("job_id").alias("id"), F.col("title").alias("name"), F.lit("2024-05-01").alias("releasedDate"), F.struct(F.lit("Porto").alias("city")).alias("location"))))
    own = own.otherwise(F.to_json(F.struct(F.col("k").alias("adId"), "title", F.lit("text").alias("description"), F.lit("2024-05-01").alias("postedAt"))))
    place = F.create_map(*[F.lit(x) for p in ("workable", "smartrecruiters", "jobadder") for x in (p, landed.LISTS[p])])
    # Of the keys in a span of so many times 60, one in 60 (3 providers, 5 boards, 4 pages) is of one page.
    response = F.floor(F.col("k") / (60 * RESPONSE))
    pages = posted.withColumn("own", own).groupBy("provider", "slug", "page", response.alias("response")).agg(F.array_join(F.collect_list("own"), ",").alias("items"))
    body = F.concat(F.lit('{"'), F.try_element_at(place, F.col("provider")), F.lit('": ['), F.col("items"), F.lit("]}"))
    failed = F.col("slug") == "board-4"
    status = F.when(failed & (F.col("provider") == "workable"), 404).when(failed & (F.col("provider") == "smartrecruiters"), 503).otherwise(200)
    lost = failed & (F.col("provider") == "jobadder")
    envelope = lambda kind, key, status, lost, body: F.to_json(F.struct("provider", "slug", F.lit(kind).alias("kind"), "page", key.alias("key"), status.alias("status"), lost.alias("network_failed"), body.alias("body")))
    lists = pages.select(envelope("list", F.lit(None).cast("string"), status, lost, F.when(status == 200, body)).alias("value"))
    detail = F.when(F.col("provider") == "workable", F.to_json(F.struct(F.col("job_id").alias("shortcode"), F.concat("title", F.lit("!")).alias("title"), F.lit("detail").alias("description"))))
    detail = detail.otherwise(F.to_json(F.struct(F.concat("title", F.lit("!")).alias("name"), F.struct(F.struct(F.struct(F.lit("Job").alias("title"), F.lit("Do").alias("text")).alias("jobDescription")).alias("sections")).alias("jobAd"))))
    there = F.col("k") % 7 != 0
    details = posted.filter("provider <> 'jobadder'").filter(~failed).select(envelope("detail", F.col("job_id"), F.when(there, 200).otherwise(500), F.lit(False), F.when(there, detail)).alias("value"))
    ingest.spread(lists.union(details)).write.text(folder)


def read(t):
    folder = f"{shared_folder(t.spark, 'landed')}/responses"
    _land(t, folder)
    t.spark.dataSource.register(landed.LandedResponses)
    return t.spark.read.format("board_responses").load(folder)


query("s15_landed_boards", f"""
WITH p AS ({POSTED})
SELECT provider, slug, CASE WHEN {FAILS} THEN 0 ELSE count(DISTINCT page) END AS pages, CASE WHEN {FAILS} THEN 0 ELSE count(*) END AS listed, count(*) FILTER (provider <> 'jobadder' AND k % 7 = 0 AND NOT {FAILS}) AS missing,
  CASE WHEN {FAILS} THEN CASE provider WHEN 'workable' THEN 'invalid_ats_slug' WHEN 'smartrecruiters' THEN 'fetch_failed' ELSE 'fetch_network_failed' END END AS error FROM p GROUP BY provider, slug""", "jobs_v")(lambda t: landed.board_outcomes(read(t)))


def landed_postings(t):
    whole = landed.postings(read(t))
    parts = [boards.normalise(whole.filter(F.col("provider") == p), p, "2024-06-01") for p in ("workable", "smartrecruiters", "jobadder")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("job_id", "title", "description", "remote_scope")


query("s06_landed_postings", f"""
WITH p AS ({POSTED})
SELECT concat(provider, ':', slug, ':', CASE provider WHEN 'jobadder' THEN CAST(k AS VARCHAR) ELSE job_id END) AS job_id, CASE WHEN {DETAILED} THEN concat(title, '!') ELSE title END AS title,
  CASE provider WHEN 'workable' THEN CASE WHEN k % 7 <> 0 THEN 'detail' ELSE 'summary' END WHEN 'smartrecruiters' THEN CASE WHEN k % 7 <> 0 THEN '<h3>Job</h3>' || chr(10) || 'Do' ELSE '' END ELSE 'text' END AS description,
  CASE WHEN provider = 'smartrecruiters' THEN 'porto' ELSE '' END AS remote_scope FROM p WHERE NOT {FAILS}""", "jobs_v")(landed_postings)

#: Company pages as they stand in a repository's zip: with front matter, for some without an address.
PAGES = "SELECT company_id, concat('pages/company-', CAST(company_id AS VARCHAR(20)), CASE WHEN company_id % 10 = 0 THEN '.txt' ELSE '.md' END) AS name, concat('---', chr(10), 'title: \"', legal_name, '\"', chr(10), CASE WHEN careers_url IS NULL THEN '' ELSE concat('website: ', careers_url, chr(10)) END, '---', chr(10), 'Text') AS value FROM companies_v"
query("s17_zipped_pages", "SELECT legal_name AS name, careers_url AS url FROM companies_v WHERE careers_url IS NOT NULL AND company_id % 10 <> 0")(
    lambda t: discovery.companies_of_pages(archives.members(archives.zipped(rows(t, PAGES), "name", "value", F.col("company_id") % 7), suffix=".md"))
)

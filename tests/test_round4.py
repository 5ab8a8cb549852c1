"""Findings of round 4: work that was done several times over, and results that depended on how rows arrive."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vacantia import catalog
from vacantia.functions import classify
from vacantia.operators import state
from vacantia.plans import ingest, landed_queries, tick_queries
from vacantia.plans.bindings import Tables
from vacantia.sources import boards, landed

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")


def optimised(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_salary_backfill_reads_a_text_once(spark):
    rows = [("a", "Dev", "Salary: 80k-90k eur", None, None, None), ("b", "Dev 1", "no word of it", None, None, None), ("c", "Dev", "Salary: 80k-90k eur", 5, None, None)]
    jobs = spark.createDataFrame(rows, "job_id string, title string, description string, salary_min int, salary_max int, salary_currency string")
    filled = state.filled_salary(jobs)
    assert optimised(filled).count("regexp_extract_all(") == 1
    assert {r.job_id: (r.salary_min, r.salary_max, r.salary_currency) for r in filled.collect()} == {"a": (80000, 90000, "EUR"), "b": (None, None, None), "c": (5, None, None)}


def test_taxonomy_tries_each_list_once(spark):
    rows = [("Senior Site Reliability Engineer", None), ("Account Executive", "Engineering"), (None, "hr")]
    read = spark.createDataFrame(rows, "title string, department string").select(classify.taxonomy(F.col("title"), F.col("department")).alias("x")).select("x.*")
    assert optimised(read).count("account executive") == 2  # of the title and of the department
    assert [tuple(r) for r in read.collect()] == [("software_development", "engineer", "senior", "sre"), ("software_development", "unknown", "unknown", "unknown"), ("hr", "unknown", "unknown", "unknown")]


@tables
def test_tick_processes_each_posting_once_over_all_cores(spark):
    assert catalog.queries()["o01_tick"](spark, FOLDER).filter("NOT ok").count() == 0
    processed = tick_queries.whole_tick(Tables(spark, FOLDER))[0].get("processed")
    assert processed.count() == processed.select("job_id").distinct().count()
    assert ingest.spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_late_sighting_keeps_the_later_one(spark):
    kind = "source string, source_job_id string, job_id string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, seen_count int"
    make = lambda job, first, last: spark.sql(f"SELECT 's' AS source, '1' AS source_job_id, '{job}' AS job_id, TIMESTAMP_NTZ '{first}' AS first_seen_at, TIMESTAMP_NTZ '{last}' AS last_seen_at, 1 AS seen_count")
    merged = spark.createDataFrame([], kind)
    for batch in (make("a", "2000-01-02", "2000-01-09"), make("b", "2000-01-01", "2000-01-05"), make("c", "2000-01-03", "2000-01-09")):
        merged = state.merged_sources(merged, batch, F.col("last_seen_at"), late=True)
    assert [(r.job_id, str(r.first_seen_at), str(r.last_seen_at), r.seen_count) for r in merged.collect()] == [("c", "2000-01-01 00:00:00", "2000-01-09 00:00:00", 3)]


@tables
def test_stream_of_many_files_gives_what_one_merge_does(spark, tmp_path):
    # One source's sightings stand in files of their own, of which the later named one is the earlier sighting.
    spark.sql("SELECT 's' AS source, '1' AS source_job_id, 'a' AS job_id, TIMESTAMP_NTZ '2000-01-01' AS first_seen_at, TIMESTAMP_NTZ '2000-01-01' + make_dt_interval(10 - id) AS last_seen_at, 2 AS seen_count FROM range(3) ORDER BY id").repartitionByRange(3, F.desc("last_seen_at")).createOrReplaceTempView("sightings_r04")

    class Sightings(Tables):
        job_sources = spark.table("sightings_r04")

    from vacantia.plans.discovery_queries import stream

    assert [(str(r.last_seen_at), r.seen_count) for r in stream(Sightings(spark, FOLDER)).collect()] == [("2000-01-11 00:00:00", 3)]


@pytest.mark.parametrize("provider", ["jobadder", "smartrecruiters", "workable", "traffit"])
def test_board_payload_is_read_once(spark, provider):
    # Filters on the posting don't read the payload again; beside it, texts that are JSON themselves may be read.
    raw = spark.createDataFrame([("s", "{"), ("s", None)], "slug string, payload string")
    posted = boards.normalise(raw, provider, "2024-06-01")
    assert optimised(posted).count("from_json(StructField(" + boards.PROVIDERS[provider][0].split()[0]) == 1
    assert posted.count() == 0


def test_landed_responses_stay_small_and_come_in_batches(spark, tmp_path, monkeypatch):
    class Many(Tables):
        jobs = spark.range(0, 60_000, 60).selectExpr("id AS k", "CAST(id AS STRING) AS job_id", "'t' AS title")

    monkeypatch.setattr(landed_queries, "RESPONSE", 100, raising=False)
    landed_queries._land(Many(spark, FOLDER), f"{tmp_path}/responses")
    lists = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/responses").collect() if '"kind":"list"' in r.value]
    sizes = [len(json.loads(r["body"])["results"]) for r in lists]
    assert (sum(sizes), max(sizes)) == (1000, 100)
    # One response of more postings than a batch holds, in a line longer than one read.
    line = json.dumps({"provider": "workable", "slug": "b", "kind": "list", "page": 0, "status": 200, "body": json.dumps({"results": [{"shortcode": str(i), "title": "x" * 1000} for i in range(2500)]})})
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "file").write_text(line + "\n\n" + line)
    batches = list(landed._read(f"{tmp_path}/one", landed._Files(["file"])))
    assert sum(b.num_rows for b in batches) == 5000
    assert max(b.num_rows for b in batches) == landed.BATCH_ROWS


@tables
def test_way_in_processes_each_posting_once(spark):
    plan = optimised(catalog.queries()["c13_process_rows"](spark, FOLDER))
    assert plan.count("Join ") == 3  # of jobs with companies, twice, and with payloads; none of postings with themselves

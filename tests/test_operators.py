"""Rules that the queries on bound tables don't reach: edges of state, search and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vacantia.functions import text
from vacantia.functions.salary import text_salary
from vacantia.operators import market, search, state
from vacantia.sources import boards


def moment(day, hour=0):
    return dt.datetime(2024, 5, day, hour)


JOB = "job_id string, source string, title string, job_fingerprint string, status string, availability_status string, first_seen_at timestamp_ntz, last_verified_at timestamp_ntz, verification_failures int"


def test_lifecycle(spark):
    rows = [
        ("1", "s", "t", "f", "active", None, moment(1), None, 3),  # failures
        ("2", "s", "t", "f", "new", "expired", moment(20), None, 0),
        ("3", "s", "t", "f", "active", None, moment(1), moment(1), 0),  # not verified for a week
        ("4", "s", "t", "f", "new", None, moment(1), None, 0),
        ("5", "s", "t", "f", "stale", "active", moment(1), moment(19), 0),
        ("6", "s", "t", "f", "new", None, moment(19, 12), None, 0),  # too young
        ("7", "s", "t", "f", "expired", "active", moment(1), moment(19), 0),
    ]
    got = {r.job_id: r.status for r in state.lifecycle(spark.createDataFrame(rows, JOB), "2024-05-20").collect()}
    assert got == {"1": "expired", "2": "expired", "3": "stale", "4": "active", "5": "active", "6": "new", "7": "expired"}


def test_merge_keeps_what_is_set(spark):
    old = spark.createDataFrame([("1", "a", "x", "f", "active", "active", moment(5), moment(6), 2), ("2", None, "x", "f", "active", None, moment(5), None, 0)], JOB)
    new = spark.createDataFrame([("1", "b", "y", "g", "new", moment(3)), ("2", "b", "y", "f", "new", moment(9)), ("3", "c", "z", "h", "new", moment(9))], "job_id string, source string, title string, job_fingerprint string, status string, first_seen_at timestamp_ntz")
    got = {r.job_id: r for r in state.merged_jobs(old, new).collect()}
    assert [got[i].source for i in "123"] == ["a", "b", "c"]
    assert [got[i].first_seen_at for i in "123"] == [moment(3), moment(5), moment(9)]
    assert got["1"].status == "new" and got["1"].verification_failures == 2 and got["1"].availability_status == "active"
    assert [r.job_id for r in state.snapshots(old, new).collect() if r.title == "x"] == ["1", "2"]


def test_first_day_is_frozen(spark):
    table = spark.createDataFrame([("2024-05-01", 5)], "date string, n int")
    new = spark.createDataFrame([("2024-05-01", 9), ("2024-05-02", 1), ("2024-05-02", 1)], "date string, n int")
    assert sorted(map(tuple, market.keep_first(table, new, "date").collect())) == [("2024-05-01", 5), ("2024-05-02", 1)]
    assert sorted(map(tuple, market.replace_by_key(table, new.limit(1), "date").collect())) == [("2024-05-01", 9)]


def test_bounds():
    with pytest.raises(ValueError):
        search.bounded(0, 0)
    with pytest.raises(ValueError):
        search.bounded(10, -1)
    for days in (6, 181):
        with pytest.raises(ValueError):
            search.bounded_days(days)
    assert search.bounded_days(30) == 30


def test_rows_of_one_job_in_a_batch(spark):
    """As if they had come one by one: the first set source, the earliest sight, and all else from the last."""
    rows = [("1", None, "a", moment(5), 0), ("1", "s", "b", moment(3), 1), ("1", "t", None, moment(9), 2), ("2", None, "c", moment(1), 3)]
    batch = spark.createDataFrame(rows, "job_id string, source string, title string, first_seen_at timestamp_ntz, n int")
    got = sorted(tuple(r) for r in state.one_of_each_job(batch, order=F.col("n")).drop("n").collect())
    assert got == [("1", "s", None, moment(3)), ("2", None, "c", moment(1))]
    old = batch.limit(0).drop("n")
    assert state.merged_jobs(old, batch.drop("n")).count() == 2
    seen = spark.createDataFrame([("s", "x", "1", moment(5), moment(6), 0), ("s", "x", "2", moment(4), moment(8), 1)], "source string, source_job_id string, job_id string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, n int")
    none = spark.createDataFrame([], "source string, source_job_id string, job_id string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, seen_count int")
    row = state.merged_sources(none, seen, F.col("n")).first()
    assert (row.job_id, row.first_seen_at, row.last_seen_at, row.seen_count) == ("2", moment(4), moment(8), 2)


def test_jobs_without_a_fingerprint_stay_apart(spark):
    comes = spark.createDataFrame([(1, "a", None, "s", "1"), (2, "b", None, "s", "2"), (3, "c", "f", "s", "3"), (4, "d", "f", "s", "4"), (5, "e", None, "s", "9")], "position int, job_id string, job_fingerprint string, source string, source_job_id string")
    jobs = spark.createDataFrame([("known", None, "s", "9")], "job_id string, job_fingerprint string, source string, source_job_id string")
    sources = spark.createDataFrame([], "source string, source_job_id string, job_id string")
    got = {r.job_id: r.canonical_id for r in state.canonical_ids(comes, jobs, sources).collect()}
    assert got == {"a": "a", "b": "b", "c": "c", "d": "c", "e": "known"}


def test_salaries_in_long_texts(spark):
    text = "pay " * 30_000 + "Salary: €80k–€100k per year" + " no pay" * 30_000
    got = spark.createDataFrame([(text,), ("x" * 50_000,), ("9" * 50_000,), (None,)], "t string").select(text_salary(F.lit(None), F.col("t")).alias("s")).collect()
    assert (got[0].s.salary_min, got[0].s.salary_max, got[0].s.salary_currency) == (80000, 100000, "EUR")
    assert [r.s.salary_min for r in got[1:]] == [None] * 3


def test_entities_decode_once(spark):
    row = spark.createDataFrame([("&amp;lt; &#65;&#x1F600; &unknown; & x",)], "t string").select(text.unescaped(F.col("t")).alias("t")).first()
    assert row.t == "&lt; A😀 &unknown; & x"


def test_xml_positions(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<p><position><id>1</id><name>Dev</name><office>Remote</office><jobDescriptions><jobDescription><name>You</name><value> code </value></jobDescription><jobDescription><name/><value>more</value></jobDescription></jobDescriptions></position></p>")
    raw = boards.read_positions(spark, str(tmp_path / "feed.xml"), "acme")
    row = boards.normalise(raw, "personio", "2024-05-01").first()
    assert (row.job_id, row.description, row.remote_source_flag) == ("personio:acme:1", "<h3>You</h3>\ncode\n\nmore", True)


def test_details_replace_summaries(spark):
    summaries = spark.createDataFrame([("a", "s1"), ("b", "s2")], "code string, payload string")
    details = spark.createDataFrame([("b", "d2")], "code string, payload string")
    assert sorted(map(tuple, boards.with_details(summaries, details, "code").collect())) == [("a", "s1"), ("b", "d2")]


def test_tick_isolates_failures():
    from vacantia.plans import tick

    done = tick.run_steps([("a", lambda: 3), ("b", lambda: 1 / 0), ("c", lambda: None)])
    assert [o.ok for o in done] == [True, False, True]
    assert [o.ok for o in tick.run_steps([("a", lambda: 1)], budget=0.0)] == [False]
    assert "ZeroDivisionError" in tick.report(done) and tick.report(done).endswith("2 ok, 1 failed")

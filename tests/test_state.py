"""State across restarts, payloads of any shape, repeated rows and missing fingerprints."""

import datetime as dt
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vacantia.functions import payload
from vacantia.functions.text import unescaped
from vacantia.operators import state
from vacantia.streaming.keyed_state import CURSORS, KeyedState, ingest_stream

ROW = "source string, source_job_id string, job_id string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, seen_count int"
KEYS = ["source", "source_job_id"]


def sighting(source, i, day, job=None):
    return (source, str(i), job or f"j{i}", dt.datetime(2024, 5, day), dt.datetime(2024, 5, day), 1)


def land(spark, folder, name, rows):
    spark.createDataFrame(rows, ROW).coalesce(1).write.parquet(f"{folder}/landed/{name}")


def by_order(old, new):
    return state.merged_sources(old, new, F.col("last_seen_at"))


def table(spark, folder, buckets=16):
    return KeyedState(spark, f"{folder}/state", spark.createDataFrame([], ROW).schema, KEYS, buckets)


def content(kept):
    return sorted((r.source, r.source_job_id, r.seen_count) for r in kept.read().collect())


def run(spark, folder, kept):
    return ingest_stream(spark, f"{folder}/landed/*", spark.createDataFrame([], ROW).schema, kept, by_order, f"{folder}/checkpoint")


def test_restart_and_replay(spark, tmp_path):
    folder = f"file://{tmp_path}"
    land(spark, folder, "a", [sighting("s", i, 1) for i in range(20)])
    assert run(spark, folder, table(spark, folder)) == 0
    first = content(table(spark, folder))
    # Started again without a new file: nothing is lost, nothing is counted twice.
    assert run(spark, folder, table(spark, folder)) == 0 and content(table(spark, folder)) == first
    land(spark, folder, "b", [sighting("s", 3, 2), sighting("s", 99, 2)])
    assert run(spark, folder, table(spark, folder)) == 1
    want = sorted([("s", str(i), 2 if i == 3 else 1) for i in range(20)] + [("s", "99", 1)])
    assert content(table(spark, folder)) == want
    # A batch that is handed over again is the version that it became.
    kept = table(spark, folder)
    again = spark.createDataFrame([sighting("s", 3, 2)], ROW)
    assert kept.merge(again, by_order, "other", 7) == 2 and kept.merge(again, by_order, "other", 7) == 2
    assert dict((i, n) for _, i, n in content(kept))["3"] == 3
    assert [n for _, i, n in sorted((r.source, r.source_job_id, r.seen_count) for r in kept.read(version=1).collect()) if i == "3"] == [2]


def test_files_of_an_uncommitted_version_are_not_read(spark, tmp_path):
    folder = f"file://{tmp_path}"
    kept = table(spark, folder)
    kept.merge(spark.createDataFrame([sighting("s", 1, 1)], ROW), by_order)
    # A driver that was lost behind the files and before the commit.
    (spark.createDataFrame([sighting("s", 2, 1)], ROW).withColumn("state_bucket", F.lit(3)).write.partitionBy("state_bucket").parquet(f"{folder}/state/rows/state_version=1"))
    assert content(table(spark, folder)) == [("s", "1", 1)]
    assert kept.merge(spark.createDataFrame([sighting("s", 5, 1)], ROW), by_order, "x", 1) == 1
    assert content(table(spark, folder)) == [("s", "1", 1), ("s", "5", 1)]


def test_a_batch_touches_its_buckets_only(spark, tmp_path):
    folder = f"file://{tmp_path}"
    kept = table(spark, folder, 64)
    kept.merge(spark.createDataFrame([sighting("s", i, 1) for i in range(400)], ROW), by_order)
    batch = spark.createDataFrame([sighting("s", 7, 2), sighting("s", 8, 2)], ROW)
    touched = kept.touched(batch)
    assert 1 <= len(touched) <= 2
    assert len(kept.read(touched).inputFiles()) == len(touched) < len(kept.read().inputFiles())
    before = {f for f in kept.read().inputFiles()}
    kept.merge(batch, by_order, "b", 1)
    after = {f for f in kept.read().inputFiles()}
    assert len(after - before) == len(touched) == len(before - after)
    assert kept.read().count() == 400 and kept.read().agg(F.sum("seen_count")).first()[0] == 402


def test_buckets_are_fixed_and_empty_batches_are_versions(spark, tmp_path):
    folder = f"file://{tmp_path}"
    assert table(spark, folder, 4).merge(spark.createDataFrame([], ROW), by_order) == 0
    assert table(spark, folder, 4).read().count() == 0
    with pytest.raises(ValueError):
        table(spark, folder, 8)


def test_rules_may_empty_a_bucket(spark, tmp_path):
    kept = table(spark, f"file://{tmp_path}")
    one = spark.createDataFrame([sighting("s", 1, 1)], ROW)
    kept.merge(one, by_order)
    kept.merge(one, lambda old, new: old.limit(0), "drop", 1)
    assert kept.read().count() == 0
    kept.merge(one, by_order, "again", 2)
    assert content(kept) == [("s", "1", 1)]


def test_cursors_move_on_success_only(spark, tmp_path):
    folder = f"file://{tmp_path}"
    schema = spark.createDataFrame([], ROW + ", error string").schema
    kept = table(spark, folder)
    cursors = KeyedState(spark, f"{folder}/cursors", spark.createDataFrame([], CURSORS).schema, ["board"], 4)
    rule = lambda old, new: by_order(old, new.drop("error"))

    def tick(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/landed/{name}")
        ingest_stream(spark, f"{folder}/landed/*", schema, kept, rule, f"{folder}/checkpoint", cursors, error="error")
        return {r.board: r.since.day for r in cursors.read().collect()}

    assert tick("a", [(*sighting("x", 1, 5), None), (*sighting("y", 1, 5), None)]) == {"x": 5, "y": 5}
    # x is read again from its cursor on, inclusively; y fails half way: what came counts, its cursor stays.
    assert tick("b", [(*sighting("x", 1, 5), None), (*sighting("x", 2, 4), None), (*sighting("y", 2, 9), None), ("y", None, None, None, None, None, "fetch_failed")]) == {"x": 5, "y": 5}
    assert content(kept) == [("x", "1", 2), ("y", "1", 1), ("y", "2", 1)]
    assert tick("c", [(*sighting("y", 2, 9), None), ("y", "3", "j3", None, None, 1, None)]) == {"x": 5, "y": 9}
    assert ("y", "3", 1) in content(kept)


def test_snapshots_once_for_repeated_rows(spark):
    job = "job_id string, title string, job_fingerprint string"
    old = spark.createDataFrame([("1", "a", "f"), ("2", "b", "g")], job)
    new = spark.createDataFrame([("1", "c", "f"), ("1", "d", "f"), ("2", "b", "g"), ("2", "b", "g")], job)
    assert [(r.job_id, r.title) for r in state.snapshots(old, new).collect()] == [("1", "a")]
    assert state.snapshots(old, new, captured_at="2024-05-01").first().captured_at == dt.datetime(2024, 5, 1)


def test_jobs_without_a_fingerprint_stay(spark):
    jobs = spark.createDataFrame([("1", None, None, None), ("2", None, None, None), ("3", None, None, None), ("4", "f", None, None), ("5", "f", None, None)], "job_id string, job_fingerprint string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz")
    sources = spark.createDataFrame([("s", str(i), str(i), None) for i in range(1, 6)], "source string, source_job_id string, job_id string, first_seen_at timestamp_ntz")
    kept, moved = state.merged_collisions(jobs, sources)
    assert sorted(r.job_id for r in kept.collect()) == ["1", "2", "3", "4"]
    assert {r.source_job_id: r.job_id for r in moved.collect()} == {"1": "1", "2": "2", "3": "3", "4": "4", "5": "4"}
    assert [r.job_fingerprint for r in state.ranked_fingerprints(jobs, "2024-05-01").orderBy("job_id").collect()][:3] == [None] * 3


SALARIES = [
    ({}, None), ({"salary": None}, None),
    ({"salary": {"min": 100000, "max": 150000, "currency": "usd", "interval": "year"}}, (100000, 150000, "USD", "year")),
    ({"pay_input_ranges": [{"min_amount": "50", "max_amount": "80", "currency_code": "EUR", "unit": "hour"}]}, (50, 80, "EUR", "hour")),
    ({"salary": {"min": 0, "max": 0}}, None), ({"salary": {"min": "negotiable", "max": "DOE"}}, None),
    ({"salaryRange": {"minimum": 90000, "maximum": 120000, "currencyCode": "gbp"}}, (90000, 120000, "GBP", "year")),
    ({"salary": "x", "pay": {"min": 5}}, (5, None, None, "year")), ({"salary": [], "compensation": [{"max": 7}, {"max": 9}]}, (None, 7, None, "year")),
    ({"salary": {"min": {"a": 1}, "max": 5}, "pay": {"max": True}}, (None, 1, None, "year")), ({"salary": {"min": " 1_0.5 ", "period": "WEEK"}}, (10.5, None, None, "year")), ({"salary": {"minimum": "", "max": 5}}, None),
]


def test_structured_salaries(spark):
    rows = [(i, json.dumps(p)) for i, (p, _) in enumerate(SALARIES)] + [(98, "{"), (99, None)]
    found = payload.structured_salary(payload.variant(F.col("p")))
    got = {r.n: r.s for r in spark.createDataFrame(rows, "n int, p string").select("n", found.alias("s")).collect()}
    assert got[98] is None and got[99] is None
    for i, (_, want) in enumerate(SALARIES):
        assert (got[i] and (got[i].salary_min, got[i].salary_max, got[i].salary_currency, got[i].salary_period)) == want, SALARIES[i]
    assert got[2].salary_source == "structured" and round(got[2].salary_min_eur) == 92000


def shape(v):
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{shape(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return f"list[{','.join(sorted({shape(x) for x in v}))}]"
    return {bool: "bool", int: "int", float: "float", str: "str", type(None): "null"}[type(v)]


values = st.recursive(st.none() | st.booleans() | st.integers(-9999, 9999) | st.floats(-1e6, 1e6) | st.text("ab\"\\{}[]:, é😀", max_size=5), lambda s: st.lists(s, max_size=4) | st.dictionaries(st.text("ab\"\\{}[]: é", max_size=3), s, max_size=4), max_leaves=15)


@settings(max_examples=10, deadline=None)
@given(st.lists(values, min_size=30, max_size=30))
def test_shapes(spark, batch):
    rows = [(i, json.dumps(v, ensure_ascii=i % 2 == 0)) for i, v in enumerate(batch)]
    got = {r.n: r.s for r in spark.createDataFrame(rows, "n int, p string").select("n", payload.shape(F.col("p")).alias("s")).collect()}
    assert got == {i: shape(v) for i, v in enumerate(batch)}


def test_repaired_encodings(spark):
    polish, russian, german = "Zażółć gęślą jaźń, praca w Łodzi", "Мы ищем инженера в Москве", "Über 100 € – „schön“"
    texts = [german, polish, russian]
    rows = [(i, t.encode("utf-8").decode("latin-1"), t) for i, t in enumerate(texts)]
    rows += [(10, polish.encode("cp1250").decode("latin-1"), polish), (11, german.encode("cp1252").decode("latin-1"), german), (12, "Zürich, señor", "Zürich, señor"), (13, "plain", "plain"), (14, None, None), (15, "â of 😀", "â of 😀")]
    got = {r.n: r.f for r in spark.createDataFrame([r[:2] for r in rows], "n int, t string").select("n", payload.repaired(F.col("t")).alias("f")).collect()}
    assert got == {n: want for n, _, want in rows}


def test_unescaped_like_the_standard(spark):
    import html

    rng = random.Random(1)
    texts = ["caf&eacute; &Uuml;ber", "&notit; &notin; &amp;lt; &AMP &copy2 &", "&#128; &#x80; &#xD800; &#1114112; &#0; &#13; &#65 &#x41;x &#; &#x;", "&NotEqualTilde; &bne; &fjlig;", "a&b&&amp;;", "&ampamp; &ltx"]
    texts += ["".join(rng.choice(["&", "amp", ";", "lt", "eacute", "#", "x", "6", "5", "no", "t", " ", "<", "in"]) for _ in range(12)) for _ in range(200)]
    got = [r.u for r in spark.createDataFrame(list(enumerate(texts)), "n int, t string").coalesce(1).select(unescaped(F.col("t")).alias("u")).collect()]
    assert got == [html.unescape(t) for t in texts]

"""The data source of landed responses, archives, and work in chunks under a budget of time."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from vacantia.functions import classify, geo
from vacantia.plans import tick
from vacantia.sources import archives, landed


def response(provider, slug, body=None, page=1, kind="list", key=None, status=200, **more):
    return json.dumps({"provider": provider, "slug": slug, "kind": kind, "page": page, "key": key, "status": status, "body": None if body is None else json.dumps(body), **more})


def test_responses(spark, tmp_path):
    jsonapi = {"data": [{"id": "1", "relationships": {"department": {"data": {"id": "9", "type": "departments"}}, "locations": {"data": [{"id": "4"}]}}}], "included": [{"type": "departments", "id": "9"}, {"type": "locations", "id": "4"}, {"type": "locations", "id": "5"}]}
    (tmp_path / "000.json").write_text("\n".join([
        response("workable", "a", {"results": [{"shortcode": "x", "title": "X"}, {"shortcode": "y", "title": "Y"}]}),
        response("workable", "a", {"results": [{"shortcode": "y", "title": "Y2"}]}, page=2),
        response("workable", "a", {"shortcode": "x", "title": "X detail"}, kind="detail", key="x"),
        response("workable", "a", status=500, kind="detail", key="y"),
        response("smartrecruiters", "b", {"content": [{"id": 7, "name": "N", "location": {"city": "Porto"}}]}),
        response("smartrecruiters", "b", {"name": "M", "jobAd": {}}, kind="detail", key=7),
    ]))
    (tmp_path / "001.json").write_text("\n".join([response("lever", "c", [{"id": "1"}]), response("lever", "d", status=404), response("lever", "e", network_failed=True, status=None), response("lever", "f", {"no": "list"}), response("jobadder", "g", {"items": 3}), "no json", "[1]", "", response("teamtailor", "h", jsonapi), response("nobody", "i", [])]))
    (tmp_path / "_hidden").write_text("no json")
    spark.dataSource.register(landed.LandedResponses)
    read = spark.read.format("board_responses").load(f"file://{tmp_path}")
    got = {(r.provider, r.slug): (r.pages, r.listed, r.missing, r.error) for r in landed.board_outcomes(read).collect()}
    assert got == {
        ("workable", "a"): (2, 3, 1, None), ("smartrecruiters", "b"): (1, 1, 0, None), ("lever", "c"): (1, 1, 0, None), ("lever", "d"): (0, 0, 0, "invalid_ats_slug"), ("lever", "e"): (0, 0, 0, "fetch_network_failed"),
        ("lever", "f"): (0, 0, 0, "fetch_failed"), ("jobadder", "g"): (0, 0, 0, "fetch_failed"), (None, None): (0, 0, 0, "fetch_failed"), ("teamtailor", "h"): (1, 1, 0, None), ("nobody", "i"): (0, 0, 0, "fetch_failed"),
    }
    whole = {(r.provider, json.loads(r.payload).get("shortcode") or json.loads(r.payload).get("id")): json.loads(r.payload) for r in landed.postings(read).collect()}
    assert whole[("workable", "x")]["title"] == "X detail" and whole[("workable", "y")]["title"] == "Y2"
    assert whole[("smartrecruiters", 7)] == {"id": 7, "name": "M", "location": {"city": "Porto"}, "jobAd": {}}
    assert [e["id"] for e in whole[("teamtailor", "1")]["included"]] == ["9", "4"]
    assert spark.read.format("board_responses").load(f"file://{tmp_path}/nothing").count() == 0


def test_responses_as_a_stream(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "landed", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    folder.mkdir()
    spark.dataSource.register(landed.LandedResponses)

    def run():
        stream = spark.readStream.format("board_responses").load(f"file://{folder}")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((r.file, r.key) for r in spark.read.parquet(out).collect())

    (folder / "000").write_text(response("lever", "c", [{"id": "1"}, {"id": "2"}]))
    assert run() == [("000", "1"), ("000", "2")]
    # Started again, it reads what landed since and nothing twice.
    (folder / "001").write_text(response("lever", "c", [{"id": "3"}]))
    assert run() == [("000", "1"), ("000", "2"), ("001", "3")] == run()


def test_long_lines_cross_the_reader_s_chunks(spark, tmp_path):
    items = [{"id": str(i), "text": "é" * 700} for i in range(3000)]
    (tmp_path / "0").write_text(response("lever", "c", items) + "\n" + response("lever", "c", items[:1], page=2))
    spark.dataSource.register(landed.LandedResponses)
    read = spark.read.format("board_responses").load(f"file://{tmp_path}")
    assert read.count() == 3001 and read.filter("page = 2").count() == 1 and landed.postings(read).count() == 3000


def test_archives(spark):
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/one.md", "één")
        z.writestr("a/two.txt", "no")
        z.writestr("a/", "")
        z.writestr("big.md", "x" * 3000)
    data = whole.getvalue()
    broken = bytearray(data)
    broken[39:42] = b"\xff\xff\xff"  # within the first member
    rows = spark.createDataFrame([("w", bytearray(data)), ("n", bytearray(b"no zip")), ("0", None), ("b", broken)], "path string, content binary")
    got = {(r.archive, r.member): (r.value, r.error) for r in archives.members(rows, suffix=".md", largest=2000).collect()}
    assert got[("w", "big.md")] == (None, "too large") == got[("b", "big.md")]
    assert got[("w", "a/one.md")] == ("één", None) and got[("n", None)] == (None, "no zip")
    assert ("w", "a/two.txt") not in got and not any(a == "0" for a, _ in got)
    assert got[("b", "a/one.md")][0] is None and got[("b", "a/one.md")][1]


def test_chunks_under_a_budget(spark, tmp_path):
    v = tick.Versions(spark, f"file://{tmp_path}")
    work = spark.range(200).select(F.col("id").cast("string").alias("job_id"))
    now = [0.0]
    seen = []

    def handle(rows):
        n = rows.count()
        seen.append(n)
        now[0] += 5.0 if n else 0.0
        return rows.withColumn("availability_status", F.lit("active"))

    clock = lambda: now[0]
    done, left = tick.in_chunks(v, "w", work, "job_id", handle, seconds=12, size=50, clock=clock)
    assert (done, left) == (3, 1) and sum(seen) == v.get("w_done").count()
    waiting = {r.job_id for r in v.get("w_left").collect()}
    assert len(waiting) == 200 - sum(seen)
    # The next time those come first, and none is queued twice.
    seen.clear()
    done, left = tick.in_chunks(v, "w", work.limit(200), "job_id", handle, seconds=5, size=200, clock=clock)
    assert done == 1 and {r.job_id for r in v.get("w_done").collect()} == waiting
    assert v.get("w_left").count() == 200 - len(waiting)
    # Nothing to do: no chunk, nothing left.
    empty = tick.Versions(spark, f"file://{tmp_path}/empty")
    assert tick.in_chunks(empty, "w", work.limit(0), "job_id", handle, seconds=1, clock=clock) == (0, 0)


def test_a_changed_rule_is_another_policy(monkeypatch):
    import inspect

    before = geo.policy_version()
    assert before == geo.policy_version() and len(before) == 10
    real = inspect.getsource
    monkeypatch.setattr(inspect, "getsource", lambda m: real(m) + ("# changed" if m is classify else ""))
    assert geo.policy_version() != before


@pytest.mark.parametrize("title, reason", [("Sales, Brazil and United States; Spain", "united states"), ("Guinea-Bissau", "explicit_country")])
def test_first_phrase_of_a_list(spark, title, reason):
    got = spark.range(1).select(geo.geography(F.lit(title), F.lit(""), F.lit("")).alias("g")).first().g
    assert got.geo_reason == reason


def test_phrases_in_the_list_s_order(spark):
    texts = ["beta alpha", "alphabet", "x-alpha.", "gamma ray beta", "gamma", "", "ray gamma ray"]
    phrases = ["alpha", "beta", "gamma ray", "gamma", "ray"]
    got = [r.p for r in spark.createDataFrame(list(enumerate(texts)), "n int, t string").coalesce(1).select(geo._first(F.col("t"), phrases).alias("p")).collect()]
    assert got == ["alpha", None, "alpha", "beta", "gamma", None, "gamma ray"]

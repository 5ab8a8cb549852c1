"""Percentiles by rank selection and reposts by spans of time, against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.operators import audit, ranks


@pytest.mark.parametrize("fraction", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_percentiles(spark, fraction):
    rng = random.Random(4)
    groups = {"hot": [rng.gauss(0, 100) for _ in range(3000)] + [7.0] * 2000, None: [float(rng.randrange(5)) for _ in range(99)], "one": [3.5], "pair": [1.0, 2.0], "far": [1e-9 * k for k in range(50)] + [1e300, -1e300], "none": []}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("one", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r.percentile for r in ranks.exact_percentile(frame, ["k"], "v", fraction, bins=16, passes=3).collect()}
    assert set(got) == {k for k, vs in groups.items() if vs}
    for k, vs in groups.items():
        if vs:
            assert got[k] == pytest.approx(np.percentile(vs, 100 * fraction), rel=1e-12), k


def test_with_percentile_both_ways(spark):
    frame = spark.createDataFrame([(i % 3, float(i * i % 97)) for i in range(500)] + [(7, None)], "k int, v double")
    ways = [sorted(map(tuple, ranks.with_percentile(frame, ["k"], [F.count("v").alias("n")], "v", "m", direct=d).select("k", "n", "m").collect())) for d in (0, 10**6)]
    assert ways[0] == ways[1] and ways[0][-1] == (7, 0, None)
    # No group's values are collected: percentiles by rank have no such aggregate in their plan.
    plan = ranks.with_percentile(frame, ["k"], [F.count("v").alias("n")], "v", "m", direct=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan.replace("percentile#", "").replace("AS percentile", "").replace("AS m", "").lower() or "percentile_cont" not in plan


JOB = "job_id string, job_fingerprint string, company_name string, title string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"


def test_reposts_by_spans(spark):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        a = start + dt.timedelta(hours=rng.randrange(24 * 60))
        b = a + dt.timedelta(hours=rng.randrange(-30, 24 * 10))  # some end before they open
        rows.append((str(i), rng.choice(["f", "f", "g", None]), "c", "t", a, None if rng.random() < 0.05 else b))
    as_of, days = dt.datetime(2024, 3, 5), 20
    recent = [r for r in rows if r[4] > as_of - dt.timedelta(days=days + 15)]
    near = lambda j, p: None not in (j[1], p[5]) and j[1:4] == p[1:4] and j[0] != p[0] and dt.timedelta(0) < j[4] - p[5] < dt.timedelta(days=days)
    want = {j[0]: sum(near(j, p) for p in rows) for j in recent}
    jobs = spark.createDataFrame(rows, JOB)
    got = {r.job_id: r.repost_count for r in audit.repost_counts(jobs, str(as_of), days).collect()}
    assert got == want and max(want.values()) > 3
    pairs = audit.repost_candidates(jobs, str(as_of), days)
    assert pairs.count() == sum(want.values())
    assert sorted((r.job_id, r.gap_s) for r in pairs.collect()) == sorted((j[0], (j[4] - p[5]).total_seconds()) for j in recent for p in rows if near(j, p))


def test_counts_of_a_hot_fingerprint_make_no_pairs(spark):
    n = 60_000
    t = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") * 60).cast("decimal(18,6)"))
    jobs = spark.range(n).select(F.col("id").cast("string").alias("job_id"), F.lit("f").alias("job_fingerprint"), F.lit("c").alias("company_name"), F.lit("t").alias("title"), t.alias("first_seen_at"), t.alias("last_seen_at"))
    got = audit.repost_counts(jobs, "2024-02-15", 10).agg(F.sum("repost_count"), F.max("repost_count"), F.count(F.lit(1))).first()
    # Each opening counts the ends of the ten days before it, a minute apart: some 8e8 pairs that are never made.
    first_recent = (31 + 14 - 25) * 1440 + 1
    assert got[2] == n - first_recent and got[1] == 14399 and got[0] == sum(min(i, 14399) for i in range(first_recent, n))

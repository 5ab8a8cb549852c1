"""Ingestion over the known payloads, and payload functions over known cases."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from vacantia.functions import classify, payload, text
from vacantia.plans import ingest
from vacantia.plans.registry import query
from vacantia.plans.source_queries import CASES
from vacantia.plans.text_queries import cases
from vacantia.sources import boards

SHAPES = [('{"b": 1, "a": [1, 2.5, "x"], "c": {"d": null, "e": true}}', "{a:list[float,int,str],b:int,c:{d:null,e:bool}}"), ("[]", "list[]"), ('{"a": []}', "{a:list[]}")]
query("h04_schema_hash", "SELECT CAST(n AS INTEGER) AS n, CASE WHEN s = '' THEN NULL ELSE sha256(s) END AS hash FROM (VALUES " + ", ".join(f"({i}, '{s}')" for i, (_, s) in enumerate([*SHAPES, ("{", "")])) + ") v(n, s)")(
    lambda t: t.spark.createDataFrame([(i, p) for i, (p, _) in enumerate([*SHAPES, ("{", "")])], "n int, p string").select("n", payload.schema_hash(F.col("p")).alias("hash"))
)
cases("x08_mojibake", "value", [("donâ\x80\x99t", "don’t"), ("ZÃ¼rich", "Zürich"), ("Zürich", "Zürich"), ("plain", "plain"), ("Ã and 😀", "Ã and 😀"), (None, None)], lambda a: [payload.repaired(a).alias("fixed")], "fixed")
cases("x07_spam", "value source", [("Hi\nPlease mention the word CAT when applying today\nBye", "remoteok", "Hi\nBye"), ("Please mention the word CAT when applying", "lever", "Please mention the word CAT when applying")], lambda a, b: [text.without_spam(a, b).alias("clean")], "clean")
cases("c08_class_names", "remote geo", [("Hybrid", "EOG", "non_remote", "eu_region"), ("REMOTE_ONLY", "non_eu_restricted", "remote_only", "non_eu"), ("x", "global", "unknown", "unknown"), (None, None, "unknown", "unknown")], lambda a, b: [classify.remote_class_name(a).alias("r"), classify.geo_class_name(b).alias("g")], "r g")


def processed(t):
    parts = [boards.normalise(t.spark.createDataFrame([("acme-corp", json.dumps(b))], "slug string, payload string"), p, "2024-06-01") for p, b, _ in CASES.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return ingest.process(out.withColumn("company_id", F.lit("c-1")), "v1")


query("c13_process", "SELECT 'greenhouse:acme-corp:7' AS job_id, 'Hi' AS description, 'remote_only' AS remote_class, 'unknown' AS geo_class, 20 AS compliance_score, 'software_development' AS job_family, 50000 AS salary_min, 'not_disclosed' AS salary_transparency_status, 15 AS job_quality_score")(
    lambda t: ingest.process(boards.normalise(t.spark.createDataFrame([("acme-corp", json.dumps(CASES["s03_greenhouse"][1] | {"title": "Fully Remote Engineer"}))], "slug string, payload string"), "greenhouse", "2024-06-01").withColumn("company_id", F.lit("c-1")), "v1").select("job_id", "description", "remote_class", "geo_class", "compliance_score", "job_family", "salary_min", "salary_transparency_status", "job_quality_score")
)
query("k04_compliance_reports")(lambda t: ingest.compliance_reports(processed(t)))

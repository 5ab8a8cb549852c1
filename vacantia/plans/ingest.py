"""One posting's way from a source to the table, as one projection over a batch of postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions import classify, geo, payload, text
from vacantia.functions.salary import text_salary

#: Finds less sure than this go to review. Fixed value.
SURE = 80
_FOUND = ("salary_min", "salary_max", "salary_currency", "salary_period")


def spread(postings: DataFrame) -> DataFrame:
    """postings over all cores: a batch may come in one file, and its rows take long to process."""
    spark = postings.sparkSession
    return postings.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def process(postings: DataFrame, policy_version: str) -> DataFrame:
    """postings with identity, compliance, taxonomy, salary, transparency and quality.

    The description's encoding is repaired, it is cleaned, and one source's spam goes; identity, policy and
    salary see the clean one. A salary in a structured field of the payload (a column `payload`, where
    postings have one) comes before one that the text names, and both before the board's own; transparency
    asks for either of the first two. The decision's steps are kept as `decision_trace`.
    """
    c = F.col
    out = postings.withColumn("description", payload.repaired(c("description")))
    out = out.withColumn("description", text.clean_description(c("description"), c("source")))
    out = out.withColumns({
        "canonical_id": text.canonical_job_id(c("company_name"), c("title"), c("description")),
        "job_uid": text.job_uid(c("company_id"), c("title"), c("remote_scope")),
        "job_fingerprint": text.job_fingerprint(c("company_id"), c("company_name"), c("title"), c("remote_scope"), c("description")),
    })
    out = geo.policy(out).withColumn("policy_version", F.lit(policy_version))
    landed = "payload" in postings.columns
    structured = payload.structured_salary(payload.variant(c("payload"))) if landed else F.lit(None).cast(_STRUCTURED)
    out = out.withColumns({"__taxonomy": classify.taxonomy(c("title"), c("department")), "__structured": structured})
    out = out.withColumn("__text", F.when(c("__structured").isNull(), text_salary(c("title"), c("description"))))
    told = lambda k: F.coalesce(F.when(c("__structured").isNotNull(), c(f"__structured.{k}")).otherwise(c(f"__text.{k}")), F.lit(None))
    found = F.coalesce(told("salary_min"), told("salary_max")).isNotNull()
    out = out.withColumns({k: c(f"__taxonomy.{k}") for k in ("job_family", "job_role", "seniority", "specialization")})
    out = out.withColumn("__found", found)
    given = [k for k in _FOUND if k in out.columns]
    source = {"salary_source": F.when(c("__structured").isNotNull(), "structured").otherwise(c("salary_source"))} if "salary_source" in out.columns else {}
    out = out.withColumns({**{k: F.when(c("__found"), told(k).try_cast(postings.schema[k].dataType)).otherwise(c(k)) for k in given}, **source, **{k: told(k) for k in ("salary_min_eur", "salary_max_eur")}})
    if landed:
        out = out.withColumn("source_schema_hash", payload.schema_hash(c("payload")))
    out = out.withColumns({
        "needs_salary_review": c("__text.salary_min").isNotNull() & (c("__text.salary_confidence") < SURE),
        "salary_transparency_status": classify.transparency(c("description"), c("__found")),
        "job_quality_score": classify.quality_score(c("seniority"), c("specialization"), c("description"), c("salary_min"), c("source")),
    })
    return out.withColumn("needs_salary_review", F.coalesce("needs_salary_review", F.lit(False))).drop("__taxonomy", "__structured", "__text", "__found")


_STRUCTURED = "struct<salary_min:double,salary_max:double,salary_currency:string,salary_period:string,salary_source:string,salary_min_eur:double,salary_max_eur:double>"


def compliance_reports(processed: DataFrame, *more: str) -> DataFrame:
    """The reports of processed postings, one for each and policy version, with the decision's steps and more of the
    postings' columns. Nothing is taken off or added to a score apart from its classes, so penalties and bonuses stay empty."""
    return processed.select(
        "job_id", "job_uid", "policy_version", "remote_class", "geo_class", (F.coalesce("policy_reason", F.lit("")) == "geo_restriction_hard").alias("hard_geo_flag"),
        F.col("compliance_score").alias("base_score"), F.lit(None).cast("string").alias("penalties"), F.lit(None).cast("string").alias("bonuses"),
        F.col("compliance_score").alias("final_score"), F.col("compliance_status").alias("final_status"), F.to_json("decision_trace").alias("decision_vector"), "policy_reason", *more,
    )


def salary_cases(processed: DataFrame) -> DataFrame:
    return processed.filter("needs_salary_review").select("source", "job_id", "salary_min", "salary_max", "salary_currency", F.substring("description", 1, 500).alias("description_fragment"))

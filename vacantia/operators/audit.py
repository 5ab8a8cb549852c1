"""Audit statistics: compliance ratios, facets, trends, lifetimes, reposts, failing integrations.

Every function takes canonical tables and an explicit moment instead of the current time, and returns a
DataFrame that is one scan with partial aggregation wherever the question allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantia.functions.columns import ago, count_where, micros, now, percentage, seconds
from vacantia.operators import ranks

FACETS = ("status", "compliance_status", "remote_class", "geo_class")


def _verdict(name: str):
    return F.col("compliance_status") == name


def compliance_stats(jobs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    recent = jobs.filter(F.col("first_seen_at") > ago(as_of, days))
    counted = recent.agg(F.count(F.lit(1)).alias("total_jobs"), *(count_where(_verdict(v)).alias(v) for v in ("approved", "review", "rejected")))
    return counted.withColumn("approved_ratio_pct", percentage(F.col("approved"), F.col("total_jobs")))


def company_stats(jobs: DataFrame, companies: DataFrame, min_total_jobs: int = 10) -> DataFrame:
    """Jobs are counted per company id before the join, so the join sees a row per company."""
    counted = jobs.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), count_where(_verdict("approved")).alias("a"), count_where(_verdict("rejected")).alias("r"))
    named = counted.join(companies.select("company_id", "legal_name"), "company_id").groupBy("legal_name")
    out = named.agg(F.sum("n").alias("total_jobs"), F.sum("a").alias("approved"), F.sum("r").alias("rejected")).filter(F.col("total_jobs") > min_total_jobs)
    return out.withColumn("approved_ratio_pct", percentage(F.col("approved"), F.col("total_jobs"))).orderBy(F.desc("approved"), "legal_name")


def _jobs_by_source(jobs: DataFrame, job_sources: DataFrame, *also: str) -> DataFrame:
    """A row for each job and source it was seen in. Only sources of the given jobs are looked at, and
    the join fans out, so their repetitions go before it."""
    wanted = jobs.select("job_id", "compliance_status", "first_seen_at", *also)
    pairs = job_sources.select("job_id", "source").join(wanted.select("job_id"), "job_id", "left_semi").distinct()
    return wanted.join(pairs, "job_id")


def source_stats(jobs: DataFrame, job_sources: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    seen = _jobs_by_source(jobs.filter(F.col("first_seen_at") > ago(as_of, days)), job_sources)
    counted = seen.groupBy("source").agg(F.count(F.lit(1)).alias("total_jobs"), count_where(_verdict("approved")).alias("approved"), count_where(_verdict("rejected")).alias("rejected"))
    return counted.withColumn("approved_ratio_pct", percentage(F.col("approved"), F.col("total_jobs"))).orderBy(F.desc("approved"), "source")


def source_trend(jobs: DataFrame, job_sources: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per week and source: jobs, approved, rejected and the approved share."""
    recent = jobs.filter((F.col("first_seen_at") > ago(as_of, days)) & F.col("compliance_status").isNotNull())
    weekly = _jobs_by_source(recent, job_sources).groupBy(F.to_date(F.date_trunc("week", "first_seen_at")).alias("week"), "source")
    counted = weekly.agg(F.count(F.lit(1)).alias("total"), count_where(_verdict("approved")).alias("approved"), count_where(_verdict("rejected")).alias("rejected"))
    return counted.withColumn("approved_ratio_pct", percentage(F.col("approved"), F.col("total"), 1)).orderBy("week", "source")


def rejection_reasons(jobs: DataFrame, job_sources: DataFrame, reports: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Rejected jobs per source and reason. A job with reports of several policy versions can count
    under several reasons, and does."""
    rejected = jobs.filter(_verdict("rejected") & (F.col("first_seen_at") > ago(as_of, days)))
    reason = F.when(F.col("hard_geo_flag"), "hard_geo").when(F.col("remote_class") == "NON_REMOTE", "non_remote").when(F.col("geo_class") == "NON_EU", "non_eu_geo").otherwise("other")
    seen = _jobs_by_source(rejected, job_sources, "remote_class", "geo_class").join(reports.select("job_id", "hard_geo_flag"), "job_id", "left")
    return seen.groupBy("source", reason.alias("reason")).agg(F.count_distinct("job_id").alias("count")).orderBy("source", F.desc("count"))


def facets(jobs: DataFrame) -> DataFrame:
    """Counts of four columns' values in one scan with grouping sets: (facet, value, count)."""
    sets = [[c] for c in FACETS]
    counted = jobs.select(*FACETS).groupingSets(sets, *FACETS).agg(F.count(F.lit(1)).alias("count"), *(F.grouping(c).alias(f"g_{c}") for c in FACETS))
    facet, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in FACETS:
        facet, value = F.when(F.col(f"g_{c}") == 0, c).otherwise(facet), F.when(F.col(f"g_{c}") == 0, F.coalesce(c, F.lit("null"))).otherwise(value)
    return counted.select(facet.alias("facet"), value.alias("value"), "count").orderBy("facet", F.desc("count"), "value")


def source_facet(jobs: DataFrame, job_sources: DataFrame) -> DataFrame:
    """Jobs per source, all sources of the given jobs; jobs without one count under `null`."""
    seen = jobs.select("job_id").join(job_sources.select("job_id", "source").distinct(), "job_id", "left")
    return seen.groupBy(F.coalesce("source", F.lit("null")).alias("label")).agg(F.count_distinct("job_id").alias("count")).orderBy(F.desc("count"), "label")


def source_values(job_sources: DataFrame) -> DataFrame:
    named = job_sources.filter(F.col("source").isNotNull() & (F.trim("source") != ""))
    return named.groupBy("source").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "source")


def ghost_jobs(job_sources: DataFrame, as_of: str, days_threshold: int = 3, days: int = 30) -> DataFrame:
    """Postings that vanished sooner than the threshold after they were first seen."""
    gone = job_sources.filter((F.col("first_seen_at") > ago(as_of, days)) & (F.col("last_seen_at") - F.col("first_seen_at") < F.expr(f"INTERVAL {days_threshold} DAYS")))
    return gone.select("job_id", "source", "source_job_id", "first_seen_at", "last_seen_at", seconds(F.col("last_seen_at"), F.col("first_seen_at")).alias("lifetime_s"))


def lifetime_stats(job_sources: DataFrame, as_of: str, days: int = 30, direct: int = ranks.DIRECT) -> DataFrame:
    life = seconds(F.col("last_seen_at"), F.col("first_seen_at"))
    rows = job_sources.filter(F.col("first_seen_at") > ago(as_of, days)).select(life.alias("s"))
    return ranks.with_percentile(rows, [], [F.avg("s").alias("avg_lifetime_s")], "s", "median_lifetime_s", direct=direct)


_SAME = ["job_fingerprint", "company_name", "title"]


def _spans(jobs: DataFrame, as_of: str, days_threshold: int) -> tuple[DataFrame, DataFrame, int]:
    """Recent jobs at their openings and earlier ones at their ends, in spans of time as long as the gap may be
    (its microseconds come third). An earlier job stands in its own span and in the next, so a recent one
    finds in its span whatever may have come before it; a key of very many jobs is dealt by spans."""
    gap = days_threshold * 86_400_000_000
    recent = jobs.filter(F.col("first_seen_at") > ago(as_of, days_threshold + 15)).withColumn("at", micros(F.col("first_seen_at")))
    recent = recent.withColumn("span", F.floor(F.col("at") / gap))
    # An earlier one that qualifies was last seen no longer before the window than the gap may be.
    earlier = jobs.filter(F.col("last_seen_at") > ago(as_of, 2 * days_threshold + 15)).withColumn("at", micros(F.col("last_seen_at")))
    own = F.floor(F.col("at") / gap)
    return recent, earlier.withColumn("span", F.explode(F.array(own, own + 1))), gap


def repost_candidates(jobs: DataFrame, as_of: str, days_threshold: int = 30) -> DataFrame:
    """Pairs of jobs alike in fingerprint, company and title, the later one opened soon after the
    earlier one was last seen: joined by equal keys and span of time, with the gap as its residual."""
    recent, earlier, gap = _spans(jobs, as_of, days_threshold)
    recent = recent.select("job_id", "first_seen_at", "at", "span", *_SAME)
    earlier = earlier.select(F.col("job_id").alias("prev_id"), F.col("last_seen_at").alias("previous_last_seen_at"), F.col("at").alias("ended"), "span", *_SAME)
    near = (F.col("job_id") != F.col("prev_id")) & (F.col("at") > F.col("ended")) & (F.col("at") - F.col("ended") < gap)
    pairs = recent.join(earlier, [*_SAME, "span"]).filter(near)
    return pairs.select("job_id", "company_name", "title", "first_seen_at", "previous_last_seen_at", ((F.col("at") - F.col("ended")) / 1e6).alias("gap_s")).orderBy(F.desc("first_seen_at"))


def repost_counts(jobs: DataFrame, as_of: str, days_threshold: int = 30) -> DataFrame:
    """(job_id, repost_count) of recent jobs: how many earlier ones qualify. No pairs are made: openings and ends
    of one key and span stand in the order of time, and a range of it counts the ends before an opening."""
    recent, earlier, gap = _spans(jobs, as_of, days_threshold)
    keyed = F.struct(*_SAME)
    whole = recent.filter(F.greatest(*[F.col(c).isNull().cast("int") for c in _SAME]) == 0)
    columns = [keyed.alias("key"), "span", "at"]
    # A job that ends before it opens would count itself.
    own = ((F.col("at") > micros(F.col("last_seen_at"))) & (F.col("at") - micros(F.col("last_seen_at")) < gap)).cast("int")
    openings = whole.select(*columns, "job_id", F.lit(0).alias("end"), F.coalesce(own, F.lit(0)).alias("own"))
    ends = earlier.select(*columns, F.lit(None).cast(jobs.schema["job_id"].dataType).alias("job_id"), F.lit(1).alias("end"), F.lit(0).alias("own"))
    before = W.partitionBy("key", "span").orderBy("at").rangeBetween(1 - gap, -1)
    counted = openings.union(ends).withColumn("n", F.coalesce(F.sum("end").over(before), F.lit(0)) - F.col("own")).filter("end = 0").select("job_id", F.col("n").cast("long").alias("repost_count"))
    lone = recent.filter(F.greatest(*[F.col(c).isNull().cast("int") for c in _SAME]) == 1).select("job_id", F.lit(0).cast("long").alias("repost_count"))
    return counted.union(lone)


def failing_integrations(company_ats: DataFrame, companies: DataFrame, as_of: str, days_threshold: int = 3) -> DataFrame:
    limit = ago(as_of, days_threshold)
    late = (F.col("last_sync_at") < limit) | (F.col("last_sync_at").isNull() & (F.col("created_at") < limit))
    active = companies.filter("is_active").select("company_id", "legal_name")
    found = company_ats.filter(F.col("is_active") & late).drop("is_active").join(active, "company_id")
    return found.select("company_ats_id", "legal_name", "provider", "ats_slug", "last_sync_at", "created_at").orderBy(F.coalesce("last_sync_at", "created_at"))


def ats_health(company_ats: DataFrame, companies: DataFrame, as_of: str, days_threshold: int = 3) -> DataFrame:
    """Failing integrations with whole days since their last sync (or creation), never below 0."""
    days = F.floor(seconds(now(as_of), F.coalesce("last_sync_at", "created_at")) / 86400)
    return failing_integrations(company_ats, companies, as_of, days_threshold).withColumn("days_since_sync", F.greatest(F.lit(0), days).cast("int"))


def without_empty(rows: DataFrame, column: str = "approved") -> DataFrame:
    """An audit table as it is shown: rows that approve nothing are hidden."""
    return rows.filter(F.col(column) > 0)


def leftover_rows(rows: DataFrame, key: str, text: str, top: int = 5, most: int = 50) -> DataFrame:
    """The rows with most tags left in their text, `most` of them: (key, tag_count, top_tags), the tags
    with their counts, equal ones in the order of their first appearance."""
    tags = rows.filter(F.col(text).like("%<%>%")).select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit("<[^>]+>"), F.lit(0))).alias("at", "tag"))
    counted = tags.groupBy(key, "tag").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "at", "tag"))), 1, top)
    told = F.array_join(F.transform(ranked, lambda r: F.concat(r["tag"], F.lit(": "), (-r["n"]).cast("string"))), ", ")
    return counted.groupBy(key).agg(F.sum("n").alias("tag_count"), told.alias("top_tags")).orderBy(F.desc("tag_count"), key).limit(most)


def trend_pivot(trend: DataFrame, sources: list[str]) -> DataFrame:
    """Weeks by sources, approved share in each cell, from the rows of source_trend."""
    return trend.groupBy("week").pivot("source", sources).agg(F.max("approved_ratio_pct")).orderBy("week")


def reason_pivot(reasons: DataFrame) -> DataFrame:
    """Sources by reasons with totals and the share of each reason."""
    names = ["hard_geo", "non_remote", "non_eu_geo", "other"]
    table = reasons.groupBy("source").pivot("reason", names).agg(F.sum("count")).fillna(0, names)
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return table.withColumn("total", total).withColumns({f"{n}_pct": percentage(F.col(n), F.col("total"), 1) for n in names}).orderBy(F.desc("total"), "source")

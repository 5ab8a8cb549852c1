"""Job and company search: composed predicates, trigram ranking, pages, feed filters and sorts.

Predicates are plain column expressions over stored columns, so they reach the Parquet scan; a filter
by a further source is a semi join. Pages break ties by id, so that they are stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.columns import contains_text, every, trigram_distance

#: Bounds of the read interface's parameters.
MAX_LIMIT, MAX_PAID_LIMIT, MAX_OFFSET = 500, 100, 1_000_000


def bounded_days(days: int, least: int = 7, most: int = 180) -> int:
    if not least <= days <= most:
        raise ValueError(f"days must be between {least} and {most}")
    return days


def bounded(limit: int, offset: int, most: int = MAX_LIMIT) -> tuple[int, int]:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    if not 0 <= offset <= MAX_OFFSET:
        raise ValueError(f"offset must be between 0 and {MAX_OFFSET}")
    return limit, offset


def score_at_least(least: int) -> Column:
    """Up to 0 an unknown score counts as 0; above, it doesn't pass, and the column stays bare for the scan."""
    return F.coalesce("compliance_score", F.lit(0)) >= least if least <= 0 else F.col("compliance_score") >= least


def job_conditions(*, status=None, q=None, company=None, title=None, remote_scope=None, remote_class=None, geo_class=None, compliance_status=None, min_compliance_score=None, max_compliance_score=None, job_family=None, seniority=None, specialization=None, first_seen_after=None, first_seen_before=None, audit=False) -> list[Column]:
    """The conditions of a job search. The audit search differs: it has no `visible` status, matches a
    remote scope by containment, and takes an unknown score for 0 in either bound."""
    out: list[Column] = []
    if status == "visible" and not audit:
        out.append(F.col("status").isin("new", "active"))
    elif status:
        out.append(F.col("status") == status)
    out += [contains_text(c, v) for c, v in (("company_name", company), ("title", title)) if v]
    if remote_scope:
        out.append(contains_text("remote_scope", remote_scope) if audit else F.col("remote_scope") == remote_scope)
    exact = {"remote_class": remote_class, "geo_class": geo_class, "compliance_status": compliance_status, "job_family": job_family, "seniority": seniority, "specialization": specialization}
    out += [F.col(c) == v for c, v in exact.items() if v]
    if min_compliance_score is not None:
        out.append(F.coalesce("compliance_score", F.lit(0)) >= min_compliance_score if audit else score_at_least(min_compliance_score))
    if max_compliance_score is not None:
        out.append(F.coalesce("compliance_score", F.lit(0)) <= max_compliance_score)
    if first_seen_after:
        out.append(F.col("first_seen_at") >= F.lit(first_seen_after).cast("timestamp_ntz"))
    if first_seen_before:  # the day itself belongs to the range
        out.append(F.col("first_seen_at") < F.lit(first_seen_before).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    if q:
        out.append(contains_text("title", q) | contains_text("company_name", q))
    return out


def search(jobs: DataFrame, job_sources: DataFrame | None = None, *, source: str | None = None, **filters) -> DataFrame:
    found = jobs.filter(every(job_conditions(**filters)))
    if source:
        found = found.join(job_sources.filter(F.col("source") == source).select("job_id"), "job_id", "left_semi")
    return found


def page(found: DataFrame, limit: int, offset: int = 0, q: str | None = None) -> DataFrame:
    """A page, newest first, or by trigram distance of title or company from q."""
    order = [F.desc_nulls_first("first_seen_at"), F.asc("job_id")]
    if q:
        order.insert(0, F.asc_nulls_last(F.least(trigram_distance(F.col("title"), F.lit(q)), trigram_distance(F.col("company_name"), F.lit(q)))))
    limit, offset = bounded(limit, offset)
    return found.orderBy(*order).offset(offset).limit(limit)


def with_total(found: DataFrame, page: DataFrame) -> DataFrame:
    """A page's rows with the number of all rows found."""
    return page.crossJoin(found.agg(F.count(F.lit(1)).alias("total")))  # one row


def audit_page(found: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page by last sighting; jobs never seen again count as seen at the epoch."""
    limit, offset = bounded(limit, offset)
    seen = F.coalesce("last_seen_at", F.lit("1970-01-01").cast("timestamp_ntz"))
    return found.orderBy(seen.desc(), "job_id").offset(offset).limit(limit)


def companies(table: DataFrame, *, q=None, ats_provider=None, is_active=None, min_score=None) -> DataFrame:
    conditions = [contains_text("legal_name", q)] if q else []
    conditions += [F.col(c) == v for c, v in (("ats_provider", ats_provider), ("is_active", is_active)) if v is not None]
    if min_score is not None:
        conditions.append(F.col("signal_score") >= min_score)
    return table.filter(every(conditions))


def rank_companies(found: DataFrame, limit: int, q: str | None = None) -> DataFrame:
    order = [F.desc_nulls_first("signal_score"), F.asc("company_id")]
    if q:
        order.insert(0, trigram_distance(F.col("legal_name"), F.lit(q)))
    return found.orderBy(*order).limit(bounded(limit, 0)[0])


def feed_filter(jobs: DataFrame, *, search: str = "", families: list[str] | None = None, salary_min=None, salary_max=None, include_no_salary: bool = True) -> DataFrame:
    """The feed's client-side filter: words anywhere, families, overlap of salary ranges. A salary of 0
    counts as none, and one bound stands in for a missing other."""
    out = jobs
    if search:
        out = out.filter(F.lower(F.concat_ws(" ", "title", "company_name", "remote_scope", "job_family")).contains(search.lower()))
    if families:
        out = out.filter(F.col("job_family").isin(families))
    if salary_min is not None or salary_max is not None:
        some = lambda c: F.nullif(F.col(c), F.lit(0))
        low, high = F.coalesce(some("salary_min_eur"), some("salary_max_eur")), F.coalesce(some("salary_max_eur"), some("salary_min_eur"))
        fits = every([*([high >= salary_min] if salary_min is not None else []), *([low <= salary_max] if salary_max is not None else [])])
        out = out.filter(F.when(low.isNull(), F.lit(include_no_salary)).otherwise(fits))
    return out


def feed_sort(jobs: DataFrame, order: str) -> list[Column]:
    some = lambda *cs: F.coalesce(*(F.nullif(F.col(c), F.lit(0)) for c in cs))
    keys = {
        "newest": F.desc("first_seen_at"),
        "oldest": F.asc("first_seen_at"),
        "salary-desc": F.desc(F.coalesce(some("salary_max_eur", "salary_min_eur"), F.lit(0.0))),
        "salary-asc": F.asc_nulls_last(some("salary_min_eur", "salary_max_eur")),
    }
    return [keys[order], F.asc("job_id")]


def feed_page(jobs: DataFrame, order: str, limit: int = 200) -> DataFrame:
    return jobs.orderBy(*feed_sort(jobs, order)).limit(limit)

"""State transitions as functions old x incoming -> new: merges, snapshots, lifecycle, company figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantia.functions.columns import ago, count_where, now
from vacantia.functions.geo import policy
from vacantia.functions.salary import text_salary
from vacantia.operators.audit import repost_counts

#: Columns of a known job that an upsert keeps, where they are set.
KEPT = ("source", "source_job_id", "source_url", "company_id")
#: Member states that count for a company's seat. Fixed values.
EU_COUNTRIES = "PL DE FR ES IT NL SE FI DK IE PT BE AT CZ SK HU RO BG HR SI LT LV EE LU MT CY GR".split()


def next_status(as_of: str) -> Column:
    """The four lifecycle rules on the status before: they exclude each other, so one pass does."""
    verified = F.col("last_verified_at")
    expired = (F.col("verification_failures") >= 3) | F.coalesce(F.col("availability_status") == "expired", F.lit(False)) | F.coalesce(verified < ago(as_of, 30), F.lit(False))
    return (
        F.when((F.col("status") != "expired") & expired, "expired")
        .when((F.col("status") == "active") & (verified < ago(as_of, 7)), "stale")
        .when((F.col("status") == "new") & (F.col("first_seen_at") < ago(as_of, 1)), "active")
        .when((F.col("status") == "stale") & (F.col("availability_status") == "active") & (verified >= ago(as_of, 7)), "active")
        .otherwise(F.col("status"))
    )


def lifecycle(jobs: DataFrame, as_of: str) -> DataFrame:
    return jobs.withColumn("status", next_status(as_of))


def marked_reposts(jobs: DataFrame, as_of: str, days_threshold: int = 30) -> DataFrame:
    """Jobs of the last days with their repost flag and count brought up to date."""
    return _with_reposts(jobs, as_of, days_threshold).drop("__n")


def changed_reposts(jobs: DataFrame, as_of: str, days_threshold: int = 30) -> DataFrame:
    """Only the jobs whose flag or count changes: what an update would write."""
    new, old = _with_reposts(jobs, as_of, days_threshold), jobs.select(F.col("job_id").alias("__id"), F.col("is_repost").alias("__flag"), F.col("repost_count").cast("long").alias("__count"))
    both = new.filter(F.col("__n").isNotNull()).drop("__n").join(old, F.col("job_id") == F.col("__id"))
    return both.filter(~(F.col("is_repost").eqNullSafe(F.col("__flag")) & F.col("repost_count").eqNullSafe(F.col("__count")))).drop("__id", "__flag", "__count")


def _with_reposts(jobs: DataFrame, as_of: str, days_threshold: int) -> DataFrame:
    counts = repost_counts(jobs, as_of, days_threshold).select(F.col("job_id").alias("__id"), F.col("repost_count").alias("__n"))
    out = jobs.join(counts, F.col("job_id") == F.col("__id"), "left")
    known = F.col("__n").isNotNull()
    return out.withColumns({"is_repost": F.when(known, F.col("__n") > 0).otherwise(F.col("is_repost")), "repost_count": F.when(known, F.col("__n")).otherwise(F.col("repost_count")).cast("long")}).drop("__id")


def availability(code: Column) -> Column:
    """What a probe's HTTP status says; none at all means unreachable."""
    return F.when(code.isin(404, 410), "expired").when(code.isNull() | (code >= 500), "unreachable").otherwise("active")


def observed(jobs: DataFrame, observations: DataFrame) -> DataFrame:
    """Jobs after probes (job_id, availability_status, verified_at, failure): failures count up, a
    success sets them to 0."""
    seen = observations.select(F.col("job_id").alias("__id"), F.col("availability_status").alias("__a"), "verified_at", "failure")
    out = jobs.join(seen, F.col("job_id") == F.col("__id"), "left")
    probed = F.col("__id").isNotNull()
    return out.withColumns({
        "availability_status": F.when(probed, F.col("__a")).otherwise(F.col("availability_status")),
        "last_verified_at": F.when(probed, F.col("verified_at")).otherwise(F.col("last_verified_at")),
        "verification_failures": F.when(probed, F.when(F.col("failure"), F.col("verification_failures") + 1).otherwise(0)).otherwise(F.col("verification_failures")),
    }).drop("__id", "__a", "verified_at", "failure")


def one_of_each_job(incoming: DataFrame, kept: tuple[str, ...] = KEPT, order: Column | None = None) -> DataFrame:
    """A batch as if its rows had arrived one by one in `order` (as they are read): of each job KEPT columns
    are the first that are set, first_seen_at is the earliest, and all else is the last row's."""
    at, rest = "__order", [c for c in incoming.columns if c not in (*kept, "job_id", "first_seen_at")]
    rows = incoming.withColumn(at, F.monotonically_increasing_id() if order is None else order)
    set_first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(at))).alias(c) for c in kept if c in incoming.columns]
    earliest = [F.min("first_seen_at").alias("first_seen_at")] if "first_seen_at" in incoming.columns else []
    last = F.max_by(F.struct(F.lit(1).alias("__one"), *rest), F.struct(at)).alias("__last")
    return rows.groupBy("job_id").agg(*set_first, *earliest, last).select(*(F.col(f"__last.{c}").alias(c) if c in rest else c for c in incoming.columns))


def merged_jobs(old: DataFrame, incoming: DataFrame, kept: tuple[str, ...] = KEPT, order: Column | None = None) -> DataFrame:
    """Upsert by job_id: KEPT columns stay once set, the earliest first_seen_at wins, what incoming has
    otherwise replaces, and columns it lacks stay. Rows of one job in a batch become one first."""
    incoming = one_of_each_job(incoming, kept, order)
    new = incoming.select(*(F.col(c).alias(f"__{c}") for c in incoming.columns))
    both = old.join(new, F.col("job_id") == F.col("__job_id"), "full_outer")
    arrived = F.col("__job_id").isNotNull()

    def rule(c: str) -> Column:
        if c not in incoming.columns:
            return F.col(c)
        if c == "job_id" or c in kept:
            return F.coalesce(c, f"__{c}")
        if c == "first_seen_at":
            return F.least(c, f"__{c}")
        return F.when(arrived, F.col(f"__{c}")).otherwise(F.col(c))

    return both.select(*(rule(c).alias(c) for c in old.columns))


def snapshots(old: DataFrame, incoming: DataFrame, watched=("job_fingerprint", "title", "salary_min", "salary_max", "salary_currency"), order: Column | None = None, captured_at: str | None = None) -> DataFrame:
    """The rows before the change, of jobs that change in a watched column: one each, however many rows of a
    job arrive, as these become one first. Where a moment is given, it is the snapshots' captured_at."""
    watched = [c for c in watched if c in incoming.columns and c in old.columns]
    new = one_of_each_job(incoming, order=order).select(F.col("job_id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in watched))
    same = F.lit(True)
    for c in watched:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = old.join(new, F.col("job_id") == F.col("__id")).filter(~same).select(*old.columns)
    return out if captured_at is None else out.withColumn("captured_at", now(captured_at))


def merged_sources(old: DataFrame, incoming: DataFrame, order: Column | None = None, late: bool = False) -> DataFrame:
    """Upsert of (source, source_job_id): latest job, earliest first sight, one more sighting for each row of
    the batch, whose rows count in `order` (as they are read). A batch comes after what is stored, unless it may
    be late: then the order decides there too, and a stored job and last sight that are later stay."""
    keys = ["source", "source_job_id"]
    rows = incoming.withColumn("__order", F.monotonically_increasing_id() if order is None else order)
    last = F.max_by(F.struct("job_id", "last_seen_at", "__order"), F.struct("__order")).alias("last")  # a struct: rows without an order count, as the first
    rows = rows.groupBy(*keys).agg(last, F.min("first_seen_at").alias("__first_seen_at"), F.count(F.lit(1)).alias("__n"))
    new = rows.select(*keys, "__first_seen_at", "__n", F.col("last.job_id").alias("__job_id"), F.col("last.last_seen_at").alias("__last_seen_at"), F.struct("last.__order").alias("__order"))
    out = (old.withColumn("__stored", F.struct(order)) if late else old).join(new, keys, "full_outer")
    arrived, known = F.col("__n").isNotNull(), F.col("job_id").isNotNull()
    stays = arrived & known & (F.col("__stored") > F.col("__order")) if late else F.lit(False)
    return out.select(
        *keys,
        F.when(stays, F.col("job_id")).otherwise(F.coalesce("__job_id", "job_id")).alias("job_id"),
        F.least("first_seen_at", "__first_seen_at").alias("first_seen_at"),
        F.when(stays, F.col("last_seen_at")).otherwise(F.coalesce("__last_seen_at", "last_seen_at")).alias("last_seen_at"),
        (F.when(known, F.col("seen_count")).otherwise(0) + F.when(arrived, F.col("__n")).otherwise(0)).cast("int").alias("seen_count"),
    )


def canonical_ids(incoming: DataFrame, jobs: DataFrame, job_sources: DataFrame) -> DataFrame:
    """The id each incoming row gets: of the job with its fingerprint, else of the job its source and
    source id are mapped to, else of a job that carries them itself (where jobs has source_job_id), else
    its own; within the batch the first row of a fingerprint decides. A NULL fingerprint is none.
    incoming: job_id, job_fingerprint, source, source_job_id, position."""
    by_print = jobs.groupBy("job_fingerprint").agg(F.min("job_id").alias("__by_print"))
    by_source = job_sources.groupBy("source", "source_job_id").agg(F.min("job_id").alias("__by_source"))
    found = incoming.join(by_print, "job_fingerprint", "left").join(by_source, ["source", "source_job_id"], "left")
    if "source_job_id" in jobs.columns:
        found = found.join(jobs.groupBy("source", "source_job_id").agg(F.min("job_id").alias("__by_job")), ["source", "source_job_id"], "left")
    else:
        found = found.withColumn("__by_job", F.lit(None).cast("string"))
    found = found.withColumn("__id", F.coalesce("__by_print", "__by_source", "__by_job", "job_id"))
    # Rows without a fingerprint are groups of one, and no hot key.
    alone = F.when(F.col("job_fingerprint").isNull(), F.col("position"))
    first = F.first("__id").over(W.partitionBy("job_fingerprint", alone).orderBy("position"))
    return found.select("position", "job_id", "job_fingerprint", first.alias("canonical_id"))


def company_figures(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """Job counts, last active job and remote posture of every company; jobs are counted before the join."""
    counted = jobs.groupBy("company_id").agg(
        F.count("job_id").alias("__total"),
        count_where(F.col("compliance_status") == "approved").alias("__approved"),
        count_where(F.col("compliance_status") == "rejected").alias("__rejected"),
        F.max(F.when(F.col("status") == "active", F.col("first_seen_at"))).alias("last_active_job_at"),
        count_where(F.col("remote_source_flag")).alias("__remote"),
    )
    zero = F.lit(0).cast("long")
    out = companies.drop("total_jobs_count", "last_active_job_at").join(counted, "company_id", "left")
    posture = F.when((F.col("__remote") >= 3) & (F.col("remote_posture") == "UNKNOWN"), "REMOTE_FRIENDLY").otherwise(F.col("remote_posture"))
    counts = {f"{n}_jobs_count": F.coalesce(f"__{n}", zero) for n in ("approved", "rejected", "total")}
    return out.withColumns(counts | {"remote_posture": posture}).drop("__total", "__approved", "__rejected", "__remote")


def signal_scores(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """(company_id, score): posture 40 or 20, EU entity 25, EU seat 20, approved share 15 or 8, and a
    fifth more where half of the jobs disclose their salary. Exact decimals, rounded half up."""
    counted = jobs.groupBy("company_id").agg(F.count("job_id").alias("n"), count_where(F.col("compliance_status") == "approved").alias("a"), count_where(F.col("salary_transparency_status") == "disclosed").alias("d"))
    posture = F.when(F.col("remote_posture") == "REMOTE_ONLY", 40).when(F.col("remote_posture") == "REMOTE_FRIENDLY", 20).otherwise(0)
    entity = F.when(F.col("eu_entity_verified"), 25).otherwise(0)
    seat = F.when(F.col("hq_country").isin(EU_COUNTRIES), 20).otherwise(0)
    approval = F.when(10 * F.col("a") >= 8 * F.col("n"), 15).when(2 * F.col("a") >= F.col("n"), 8).otherwise(0)
    points = posture + entity + seat + F.when(F.col("n") > 0, approval).otherwise(0)
    tenths = points * F.when((F.col("n") > 0) & (2 * F.col("d") >= F.col("n")), 12).otherwise(10)
    return companies.join(counted, "company_id", "left").select("company_id", F.floor((tenths + 5) / 10).cast("int").alias("score"))


def _alone() -> Column:
    """A key of its own for each job without a fingerprint."""
    return F.when(F.col("job_fingerprint").isNull(), F.col("job_id"))


def ranked_fingerprints(jobs: DataFrame, as_of: str) -> DataFrame:
    """The latest seen job of a fingerprint keeps it; the others get one made of it and their id. A NULL
    fingerprint is none: such jobs are groups of one, and no hot key."""
    seen = F.coalesce("last_seen_at", "first_seen_at", F.lit(as_of).cast("timestamp_ntz"))
    rank = F.row_number().over(W.partitionBy("job_fingerprint", _alone()).orderBy(seen.desc(), "job_id"))
    own = F.md5(F.concat("job_fingerprint", F.lit("|"), "job_id"))
    return jobs.withColumn("__n", rank).withColumn("job_fingerprint", F.when(F.col("__n") > 1, own).otherwise(F.col("job_fingerprint"))).drop("__n")


def changed_fingerprints(jobs: DataFrame, as_of: str) -> DataFrame:
    """Only the jobs that lose their fingerprint to another: what an update would write."""
    new = ranked_fingerprints(jobs.withColumn("__old", F.col("job_fingerprint")), as_of)
    return new.filter(F.col("job_fingerprint") != F.col("__old")).drop("__old")


def first_of_each(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """Rows that come first for their key."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def quota_use(calls: DataFrame, quota: int) -> DataFrame:
    """Per key and day: calls, and how many of them the quota turns away."""
    used = calls.groupBy("key", "day").agg(F.count(F.lit(1)).alias("calls"))
    return used.withColumn("rejected", F.greatest(F.col("calls") - quota, F.lit(0).cast("long")))


def merged_collisions(jobs: DataFrame, job_sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, job_sources) after jobs of one fingerprint have become one: the first seen stays, the
    others' sources point to it unless it has the pair already. A NULL fingerprint is none, and such jobs stay."""
    first = W.partitionBy("job_fingerprint", _alone()).orderBy(F.asc_nulls_last("first_seen_at"), "job_id")
    target = jobs.select("job_id", F.first("job_id").over(first).alias("__to"))
    kept = jobs.join(target.filter(F.col("job_id") == F.col("__to")).select("job_id"), "job_id", "left_semi")
    moved = job_sources.join(target, "job_id", "left").withColumn("__own", F.coalesce(F.col("__to") == F.col("job_id"), F.lit(True))).withColumn("job_id", F.coalesce("__to", "job_id"))
    once = W.partitionBy("source", "source_job_id", "job_id").orderBy(F.desc("__own"), "first_seen_at")
    return kept, moved.withColumn("__n", F.row_number().over(once)).filter("__n = 1").drop("__n", "__own", "__to")


def resolved(jobs: DataFrame, updates: DataFrame, columns=("compliance_status", "compliance_score")) -> DataFrame:
    """Jobs after a bulk update of some columns by job_id (one row a job)."""
    new = updates.select(F.col("job_id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in columns])
    out = jobs.join(new, F.col("job_id") == F.col("__id"), "left")
    given = F.col("__id").isNotNull()
    return out.withColumns({c: F.when(given, F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).drop("__id", *[f"__{c}" for c in columns])


def filled_compliance(jobs: DataFrame, policy_version: str) -> DataFrame:
    """Jobs without a resolution, or with one of another version, resolved anew; the others as they are."""
    stale = F.col("compliance_status").isNull() | F.col("compliance_score").isNull() | ~F.col("policy_version").eqNullSafe(F.lit(policy_version))
    columns = ("remote_class", "geo_class", "compliance_status", "compliance_score")
    new = policy(jobs.filter(stale).select("job_id", "title", "description", "remote_scope")).withColumn("policy_version", F.lit(policy_version))
    return resolved(jobs, new, (*columns, "policy_version"))


def filled_salary(jobs: DataFrame) -> DataFrame:
    """Salaries out of title and description where a job has neither bound; found ones only."""
    found = F.when(F.col("salary_min").isNull() & F.col("salary_max").isNull(), text_salary(F.col("title"), F.col("description")))
    out = jobs.withColumn("__found", found)
    known = F.col("__found.salary_min").isNotNull()
    columns = [c for c in ("salary_min", "salary_max", "salary_currency", "salary_period") if c in jobs.columns]
    return out.withColumns({c: F.when(known, F.col(f"__found.{c}")).otherwise(F.col(c)) for c in columns}).drop("__found")


def filled_department(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """Departments from (job_id, department) where a job has none, cut to 255 characters."""
    new = found.select(F.col("job_id").alias("__id"), F.substring("department", 1, 255).alias("__d"))
    return jobs.join(new, F.col("job_id") == F.col("__id"), "left").withColumn("source_department", F.coalesce("source_department", "__d")).drop("__id", "__d")

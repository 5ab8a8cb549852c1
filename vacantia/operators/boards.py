"""Board and company tables: discovery lists and queues, inserts by natural key, sync bookkeeping, API keys.

Each operator is a function of tables; what a database would do row by row in a transaction is a join or
a window over a batch here. Orders are total, so that a batch gives one result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantia.functions.columns import contains_text, now, trigram_distance

#: Columns that say when a phase last looked at a company. Fixed values.
PHASES = {"careers": "careers_last_checked_at", "guess": "ats_guess_last_checked_at"}
#: Calls a day by tier (-1: no limit), and hours that a source's postings live. Fixed values.
TIER_QUOTAS = {"free": 500, "pro": 10_000, "enterprise": -1}
DEFAULT_TTL_HOURS, TTL_HOURS = 48, {"example_source": 72}
#: What a company that is only known by name starts with. Fixed values.
PLACEHOLDER = {"hq_country": "ZZ", "eu_entity_verified": False, "remote_posture": "UNKNOWN", "is_active": True, "bootstrap": True}
#: Columns that a curated entry replaces.
CURATED = ("hq_country", "eu_entity_verified", "remote_posture", "ats_provider", "careers_url")


def fetch_error(status: Column, network_failed: Column) -> Column:
    """The code of a fetch's failure, NULL for none: a lost connection, an unknown board, anything else."""
    return F.when(network_failed, "fetch_network_failed").when(status == 404, "invalid_ats_slug").when(status >= 400, "fetch_failed")


def lookup(table: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows of the table whose key is asked for, each once; a NULL finds nothing."""
    return table.join(keys.select(*on).distinct(), list(on), "left_semi")


def by_name(names: DataFrame, companies: DataFrame, name: str = "name") -> DataFrame:
    """names with company_id of the company of that legal name, in any case; of several the least id."""
    known = companies.groupBy(F.lower("legal_name").alias("__key")).agg(F.min("company_id").alias("company_id"))
    return names.join(known, F.lower(name) == F.col("__key"), "left").drop("__key")


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in no parent row."""
    return rows.join(parents.select(key), key, "left_anti")


def placeholders(names: DataFrame, companies: DataFrame, name: str = "name") -> DataFrame:
    """Companies to add so that every name has one: one for each unknown name whatever its case, spelt as
    its first spelling in order. Their ids follow from the name, so a second run adds none."""
    known = companies.select(F.lower("legal_name").alias("__key"))
    new = names.filter(F.col(name) != "").groupBy(F.lower(name).alias("__key")).agg(F.min(name).alias("legal_name")).join(known, "__key", "left_anti")
    return new.select(F.md5("__key").alias("company_id"), "legal_name", *[F.lit(v).alias(k) for k, v in PLACEHOLDER.items()])


def curated(companies: DataFrame, entries: DataFrame) -> DataFrame:
    """Companies after curated entries (legal_name and CURATED columns): they replace what is known of a
    company and end its time as a placeholder; entries of unknown names are new companies."""
    new = entries.select(F.lower("legal_name").alias("__key"), F.col("legal_name").alias("__name"), *[F.col(c).alias(f"__{c}") for c in CURATED])
    both = companies.join(new, F.lower("legal_name") == F.col("__key"), "full_outer")
    come = F.col("__key").isNotNull()
    rule = {c: F.when(come, F.col(f"__{c}")).otherwise(F.col(c)) for c in CURATED if c in companies.columns}
    rule |= {"company_id": F.coalesce(F.col("company_id").cast("string"), F.md5("__key")), "legal_name": F.coalesce("legal_name", "__name"), "is_active": F.when(come, True).otherwise(F.col("is_active")), "bootstrap": F.when(come, False).otherwise(F.col("bootstrap"))}
    return both.select(*[(rule[c] if c in rule else F.col(c)).alias(c) for c in companies.columns])


def _near(columns: tuple[str, ...], q: str) -> Column:
    return F.least(*[trigram_distance(F.col(c), F.lit(q)) for c in columns])


def discovered(company_ats: DataFrame, companies: DataFrame, limit: int = 100, q: str | None = None) -> DataFrame:
    """Found boards with their companies, newest first, or by likeness of the name to q."""
    rows = company_ats.join(companies.select("company_id", F.col("legal_name").alias("company_name")), "company_id")
    order = [F.desc("created_at"), F.asc("company_ats_id")]
    if q:
        rows, order = rows.filter(contains_text("company_name", q)), [_near(("company_name",), q), *order]
    return rows.orderBy(*order).limit(limit).select("company_name", "provider", "ats_slug", "created_at")


def candidates(companies: DataFrame, limit: int = 50, q: str | None = None) -> DataFrame:
    """Companies with a careers page and no board, those never looked at first."""
    rows = companies.filter("ats_provider IS NULL AND careers_url IS NOT NULL")
    order = [*[F.asc_nulls_first(c) for c in PHASES.values()], F.asc("company_id")]
    if q:
        rows, order = rows.filter(contains_text("legal_name", q)), [_near(("legal_name",), q), *order]
    return rows.orderBy(*order).limit(limit).select("company_id", "legal_name", "careers_url", *PHASES.values())


def phase_queue(companies: DataFrame, phase: str, limit: int = 50) -> DataFrame:
    """The active candidates that a phase looks at next: never looked at, then longest ago."""
    waiting = companies.filter("is_active AND ats_provider IS NULL AND careers_url IS NOT NULL")
    return waiting.orderBy(F.asc_nulls_first(PHASES[phase]), "company_id").limit(limit).select("company_id", "legal_name", "careers_url")


def slugs(table: DataFrame, provider: str | None = None, status: str | None = None, limit: int = 100) -> DataFrame:
    """Found slugs, newest first."""
    for column, value in (("provider", provider), ("status", status)):
        table = table.filter(F.col(column) == value) if value else table
    return table.orderBy(F.desc("created_at"), "id").limit(limit)


def pending(table: DataFrame, limit: int = 200) -> DataFrame:
    """Slugs that wait, first come first."""
    return table.filter("status = 'pending'").orderBy("created_at", "id").limit(limit).select("id", "provider", "slug")


def synced(company_ats: DataFrame, outcomes: DataFrame, as_of: str) -> DataFrame:
    """Boards after a round of fetches (company_ats_id, success): only success moves the cursor, any outcome
    moves a board to the end of the queue (updated_at). Several outcomes of one board succeed if all do."""
    told = outcomes.groupBy(F.col("company_ats_id").alias("__id")).agg(F.bool_and("success").alias("__ok"))
    out = company_ats.join(told, F.col("company_ats_id") == F.col("__id"), "left")
    return out.withColumns({
        "last_sync_at": F.when(F.col("__ok"), now(as_of)).otherwise(F.col("last_sync_at")),
        "updated_at": F.when(F.col("__id").isNotNull(), now(as_of)).otherwise(F.col("updated_at")),
    }).drop("__id", "__ok")


def deactivated(company_ats: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select(F.col("company_ats_id").alias("__id")).distinct()
    return company_ats.join(gone, F.col("company_ats_id") == F.col("__id"), "left").withColumn("is_active", F.col("is_active") & F.col("__id").isNull()).drop("__id")


def ttl_hours(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TTL_HOURS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, source), F.lit(DEFAULT_TTL_HOURS))


def key_hash(raw: Column) -> Column:
    return F.sha2(raw.cast("binary"), 256)


def new_keys(requests: DataFrame, as_of: str) -> DataFrame:
    """Key rows of (key_id, raw_key, label, tier): the key itself is not kept."""
    quota = F.try_element_at(F.create_map(*[F.lit(x) for pair in TIER_QUOTAS.items() for x in pair]), F.col("tier"))
    return requests.select("key_id", key_hash(F.col("raw_key")).alias("key_hash"), "label", "tier", quota.alias("quota_per_day"), F.lit(0).alias("requests_today"), F.to_date(now(as_of)).alias("quota_reset_date"), F.lit(True).alias("is_active"), now(as_of).alias("created_at"))


def listed_keys(keys: DataFrame) -> DataFrame:
    return keys.drop("key_hash").orderBy(F.desc("created_at"), "key_id")


def revoked(keys: DataFrame, ids: list[str]) -> DataFrame:
    return keys.withColumn("is_active", F.col("is_active") & ~F.col("key_id").isin(ids))


def counted_calls(keys: DataFrame, calls: DataFrame, today: str) -> DataFrame:
    """Keys after a day's calls (key_id): a counter of another day starts anew; `refused` calls are over the quota."""
    made = calls.groupBy(F.col("key_id").alias("__id")).agg(F.count(F.lit(1)).alias("__n"))
    out = keys.join(made, F.col("key_id") == F.col("__id"), "left")
    day = F.lit(today).cast("date")
    before = F.when(F.col("quota_reset_date").isNull() | (F.col("quota_reset_date") < day), 0).otherwise(F.col("requests_today"))
    used = F.when(F.col("__n").isNotNull(), before + F.col("__n")).otherwise(F.col("requests_today")).cast("long")
    over = F.when((F.col("quota_per_day") >= 0) & F.col("__n").isNotNull(), F.greatest(F.lit(0), F.least(F.col("__n"), used - F.col("quota_per_day")))).otherwise(0).cast("long")
    return out.withColumns({"requests_today": used, "quota_reset_date": F.when(F.col("__n").isNotNull(), day).otherwise(F.col("quota_reset_date")), "refused": over}).drop("__id", "__n")


def ingestion_counters(processed: DataFrame, *by: str) -> DataFrame:
    """Counters of an ingestion's postings per group. A posting counts as a policy rejection by its reason;
    partial counters of batches are merged by merged_counters."""
    reason, model = F.col("policy_reason"), F.lower(F.trim(F.coalesce("remote_class", F.lit(""))))
    kind = F.when(model == "remote_only", "remote_only").when(model.isin("remote_region_locked", "remote_but_geo_restricted"), "geo_restricted").when(model.isin("office_first", "hybrid"), "non_remote").otherwise("unknown")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return processed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("fetched"), count(F.col("accepted")).alias("accepted"), count(~F.col("accepted")).alias("skipped"),
        count(reason.isin("geo_restriction_hard", "geo_restriction", "non_remote")).alias("rejected_policy_count"), count(reason == "geo_restriction_hard").alias("hard_geo_rejected_count"),
        *[count(kind == k).alias(f"model_{k}") for k in ("remote_only", "geo_restricted", "non_remote", "unknown")],
        count(F.col("has_salary")).alias("salary_detected"), count(~F.col("has_salary")).alias("salary_missing"),
    )


def merged_counters(partials: DataFrame, *by: str) -> DataFrame:
    return partials.groupBy(*by).agg(*[F.sum(c).alias(c) for c in partials.columns if c not in by])


def class_shares(rows: DataFrame, column: str) -> DataFrame:
    """Rows of each class and their share in percent, one decimal."""
    counted = rows.groupBy(F.coalesce(column, F.lit("none")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("pct", F.round(F.col("n") / F.sum("n").over(W.partitionBy()) * 100, 1))  # a row for each class


def recommendation(remote_pct: Column, eu_pct: Column) -> Column:
    """How well a board suits, by its shares of remote and of EU postings."""
    return F.when((remote_pct > 30) & (eu_pct > 10), "STRONG").when(remote_pct > 20, "CONDITIONAL").otherwise("WEAK")


def eu_scope(scope: Column) -> Column:
    """The scope audit's class of a posting."""
    s = F.lower(F.coalesce(scope, F.lit("")))
    return F.when(s.contains("us only") | s.contains("usa only") | s.contains("north america only"), "EU_INCOMPATIBLE").when(s.contains("eu"), "EU_EXPLICIT").when(s.contains("worldwide"), "EU_COMPATIBLE").otherwise("EU_UNKNOWN")

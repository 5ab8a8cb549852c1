"""Ticks: named steps in order, each one's failure kept to itself, and a report of what they did.

The steps of the ingestion tick and of discovery are wired here over versioned tables: a step reads the
last version of what it needs and writes the next one of what it changes.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import text
from vacantia.operators import boards as tables
from vacantia.operators import market, state
from vacantia.plans import exports, ingest
from vacantia.sources import boards, discovery


@dataclass
class Outcome:
    step: str
    ok: bool
    seconds: float
    result: object = None


def run_steps(steps: list[tuple[str, Callable[[], object]]], budget: float | None = None) -> list[Outcome]:
    """Run each step; a step that raises is reported with its error, and the next one runs. Steps that the
    budget of seconds leaves no time for are reported as not started."""
    out, start = [], time.perf_counter()
    for name, step in steps:
        began = time.perf_counter()
        if budget is not None and began - start >= budget:
            out.append(Outcome(name, False, 0.0, "not started: out of time"))
            continue
        try:
            ok, result = True, step()
        except Exception as error:  # a step's failure must not stop the tick
            ok, result = False, f"{type(error).__name__}: {error}"
        out.append(Outcome(name, ok, time.perf_counter() - began, result))
    return out


def report(outcomes: list[Outcome]) -> str:
    """A text table of a tick's steps."""
    width = max([4, *(len(o.step) for o in outcomes)])
    lines = [f"{'step':<{width}}  state   seconds  result"]
    lines += [f"{o.step:<{width}}  {'ok' if o.ok else 'failed':<6}  {o.seconds:7.2f}  {'' if o.result is None else o.result}" for o in outcomes]
    return "\n".join([*lines, f"{sum(o.ok for o in outcomes)} ok, {sum(not o.ok for o in outcomes)} failed"])


@dataclass
class Versions:
    """Tables in a shared folder, each in numbered versions; a failed step leaves the last one in force."""

    spark: SparkSession
    folder: str
    last: dict[str, int] = field(default_factory=dict)

    def put(self, name: str, rows: DataFrame) -> str:
        number = self.last.get(name, -1) + 1
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/version={number}")
        self.last[name] = number
        return f"{name} {number}"

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/version={self.last[name]}")


def _kept_by_key(table: DataFrame, new: DataFrame, keys: list[str], last: str) -> DataFrame:
    """Upsert by key: rows whose key is new's give way, of new's own the one that is last by a column stays;
    columns that one side lacks are NULL in its rows."""
    rest = [c for c in new.columns if c not in keys]
    new = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), last).alias("__row")).select(*keys, "__row.*")
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def in_chunks(v: Versions, name: str, work: DataFrame, key: str, handle: Callable[[DataFrame], DataFrame], seconds: float, size: int = 50, clock: Callable[[], float] = time.perf_counter) -> tuple[int, int]:
    """Handle a queue of rows chunk by chunk until it is done or the seconds are over: (chunks done, chunks left).

    Rows left over from the last time (table `{name}_left`) come first, and what is left over now replaces
    them; a key that was left over is not queued twice. What handle makes of each chunk is written behind
    it, so a chunk that is done stays done: table `{name}_done` has this time's results. Chunks are made by
    a hash of the key, about `size` rows each, so that no task numbers all rows.
    """
    before = v.get(f"{name}_left") if f"{name}_left" in v.last else None
    new = work if before is None else work.join(before.select(key), key, "left_anti")
    queue = new.withColumn("__carried", F.lit(False))
    if before is not None:
        queue = before.withColumn("__carried", F.lit(True)).unionByName(queue)
    counts = {r[0]: r[1] for r in queue.groupBy("__carried").count().collect()}
    chunks = {kind: -(-n // size) for kind, n in counts.items()}
    number = F.pmod(F.xxhash64(key), F.when(F.col("__carried"), max(1, chunks.get(True, 0))).otherwise(max(1, chunks.get(False, 0))))
    v.put(f"{name}_queue", queue.withColumn("__chunk", number))
    queue = v.get(f"{name}_queue")
    mine = lambda kind, n: (F.col("__carried") == kind) & (F.col("__chunk") == n)
    began, done, folder = clock(), [], f"{v.folder}/{name}_done/version={v.last.get(f'{name}_done', -1) + 1}"
    handle(queue.limit(0).drop("__carried", "__chunk")).write.mode("overwrite").parquet(folder)
    order = [(kind, n) for kind in (True, False) for n in range(chunks.get(kind, 0))]
    for kind, n in order:
        if clock() - began >= seconds:
            break
        handle(queue.filter(mine(kind, n)).drop("__carried", "__chunk")).write.mode("append").parquet(folder)
        done.append((kind, n))
    v.last[f"{name}_done"] = v.last.get(f"{name}_done", -1) + 1
    finished = F.lit(False)
    for kind in (True, False):
        if own := [n for k, n in done if k == kind]:
            finished = finished | ((F.col("__carried") == kind) & F.col("__chunk").isin(own))
    v.put(f"{name}_left", queue.filter(~finished).drop("__carried", "__chunk"))
    return len(done), len(order) - len(done)


def tick_steps(v: Versions, as_of: str, day: str, incoming: DataFrame, sightings: DataFrame, probes: DataFrame, policy_version: str | None = None, departments: DataFrame | None = None, probe: Callable[[DataFrame], DataFrame] | None = None, seconds: float = 15.0) -> list[tuple[str, Callable[[], object]]]:
    """The seven steps of a tick over jobs, job_sources, companies, company_ats, compliance_reports, daily_stats
    and segments. incoming: processed postings; sightings: rows of job_sources; probes: what state.observed takes.

    Ingestion also appends the snapshots of jobs that change (job_snapshots) and, of postings that carry their
    decision, writes reports by (job_uid, policy_version) and appends salaries to review (salary_cases).
    Maintenance goes on, after reposts and company figures, to signal scores and to three backfills: resolutions
    of another policy version than the given one, salaries out of texts, and departments (job_id, department)
    fetched anew; a backfill whose columns the jobs don't have is left out. Where `probe` is given, availability
    probes the rows of `probes` itself, in chunks and for so many seconds; what is left over waits for the next tick.
    """
    jobs, sources = lambda: v.get("jobs"), lambda: v.get("job_sources")

    def appended(name: str, rows: DataFrame) -> str:
        return v.put(name, v.get(name).unionByName(rows, allowMissingColumns=True) if name in v.last else rows)

    def ingestion() -> str:
        old = jobs()
        written = [v.put("job_sources", state.merged_sources(sources(), sightings)), appended("job_snapshots", state.snapshots(old, incoming, captured_at=as_of))]
        if "decision_trace" in incoming.columns:
            reports = ingest.compliance_reports(incoming).withColumn("created_at", F.lit(as_of).cast("timestamp_ntz"))
            written += [v.put("compliance_reports", _kept_by_key(v.get("compliance_reports"), reports, ["job_uid", "policy_version"], "job_id")), appended("salary_cases", ingest.salary_cases(incoming))]
        return ", ".join([*written, v.put("jobs", state.merged_jobs(old, incoming.select(*[c for c in incoming.columns if c in old.columns])))])

    def availability() -> str:
        if probe is None:
            return v.put("jobs", state.observed(jobs(), probes))
        done, left = in_chunks(v, "verification", probes, "job_id", probe, seconds)
        return f"{v.put('jobs', state.observed(jobs(), v.get('verification_done')))}, {done} chunks, {left} left"

    def market_metrics() -> str:
        v.put("daily_stats", market.keep_first(v.get("daily_stats"), market.daily_stats(jobs(), sources(), day), "date"))
        new = market.country_segments(jobs(), day).unionByName(market.column_segments(jobs(), day))
        return v.put("segments", market.replace_by_key(v.get("segments"), new, "date", "segment_type", "segment_value"))

    def maintenance() -> str:
        written = [v.put("jobs", state.marked_reposts(jobs(), as_of))]
        figures = state.company_figures(v.get("companies").drop("approved_jobs_count", "rejected_jobs_count"), jobs())
        scores = state.signal_scores(figures, jobs()).select(F.col("company_id").alias("__id"), F.col("score").alias("__score"))
        written.append(v.put("companies", figures.join(scores, F.col("company_id") == F.col("__id"), "left").withColumn("signal_score", F.col("__score")).drop("__id", "__score")))
        filled, has = jobs(), {*jobs().columns}
        if policy_version is not None and {"description", "remote_scope", "policy_version"} <= has:
            filled = state.filled_compliance(filled, policy_version)
        if {"description", "salary_min", "salary_max"} <= has:
            filled = state.filled_salary(filled)
        if departments is not None and "source_department" in has:
            filled = state.filled_department(filled, departments)
        return ", ".join([*written, v.put("jobs", filled)])

    return [
        ("ingestion", ingestion),
        ("lifecycle", lambda: v.put("jobs", state.lifecycle(jobs(), as_of))),
        ("availability", availability),
        ("market_metrics", market_metrics),
        ("maintenance", maintenance),
        ("frontend_export", lambda: v.put("feed", exports.feed_json(jobs()))),
        ("audit_export", lambda: v.put("audit_snapshot", exports.audit_json(exports.audit_parts(jobs(), sources(), v.get("companies"), v.get("company_ats"), v.get("compliance_reports"), as_of), as_of))),
    ]


def discovery_steps(v: Versions, names: DataFrame, pages: DataFrame, addresses: DataFrame, certificates: DataFrame, lines: DataFrame, harvested: DataFrame, verdicts: DataFrame) -> list[tuple[str, Callable[[], object]]]:
    """The eight steps of discovery over companies and discovered_slugs (provider, slug, discovery_source, status).

    names (name); pages (redirect, page); addresses (url, provider); certificates (name_value, provider); lines
    (value); harvested (text, evidence); verdicts (provider, slug, passed, has_token) of probed boards.
    """

    def found(rows: DataFrame, source: str) -> str:
        new = rows.filter(F.col("slug").isNotNull()).select("provider", "slug", F.lit(source).alias("discovery_source"), F.lit("pending").alias("status"))
        return v.put("discovered_slugs", market.keep_first(v.get("discovered_slugs"), new, "provider", "slug"))

    def sources() -> str:
        return v.put("companies", v.get("companies").unionByName(tables.placeholders(names, v.get("companies")), allowMissingColumns=True))

    def reverse() -> str:
        listed = discovery.listed_slugs(lines, v.get("discovered_slugs").select("slug"))
        return found(listed.withColumn("provider", F.explode(F.array(*map(F.lit, discovery.BY_PATH)))), "ats_reverse")

    def guessing() -> str:
        guesses = v.get("companies").select(F.explode(discovery.guesses(F.col("legal_name"))).alias("slug"))
        return found(guesses.join(verdicts.filter("passed"), "slug").select("provider", "slug"), "ats_guessing")

    def promote() -> str:
        told = verdicts.select(F.col("provider").alias("__p"), F.col("slug").alias("__s"), discovery.promotion(F.col("provider"), F.col("passed"), F.col("has_token")).alias("__status"))
        rows = v.get("discovered_slugs").join(told, (F.col("provider") == F.col("__p")) & (F.col("slug") == F.col("__s")), "left")
        status = F.when(F.col("status") == "pending", F.coalesce("__status", "status")).otherwise(F.col("status"))
        return v.put("discovered_slugs", rows.withColumn("status", status).drop("__p", "__s", "__status"))

    return [
        ("sources", sources),
        ("careers", lambda: found(pages.select(F.inline(F.array(discovery.board_of_page(F.col("redirect"), F.col("page")))).alias("provider", "slug")), "careers")),
        ("ats_reverse", reverse),
        ("ats_guessing", guessing),
        ("dorking", lambda: found(addresses.select("provider", discovery.slug_of_address(F.col("url"), F.col("provider")).alias("slug")), "dorking")),
        ("dorking_crt", lambda: found(discovery.certificate_slugs(certificates).withColumn("provider", F.lit("recruitee")), "dorking_crt")),
        ("slug_harvest", lambda: found(discovery.harvest(harvested), "slug_harvest")),
        ("promote_discovered", promote),
    ]


def preview(raw: DataFrame, provider: str, received_at: str, policy_version: str, job_id: str | None = None) -> DataFrame:
    """One posting on its whole way: (raw, processed), the payload without markup and what became of it."""
    one = boards.normalise(raw, provider, received_at)
    one = one.filter(F.col("source_job_id") == job_id) if job_id else one
    done = ingest.process(one.limit(1).withColumn("company_id", F.lit(None).cast("string")), policy_version)
    shown = raw.filter(F.col("payload").contains(job_id)) if job_id else raw
    payload = shown.select(F.substring(text.without_tags(F.col("payload")), 1, 3000).alias("raw")).limit(1)
    return payload.crossJoin(done.select(F.to_json(F.struct(*[c for c in done.columns if c != "description"])).alias("processed")))  # rows of one

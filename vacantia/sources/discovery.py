"""Finding boards: slugs in addresses, certificates, pages and lists, guesses from names, quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.columns import ago
from vacantia.functions.text import strip, text_or_empty

# Where providers keep a board's slug, host labels that are no board, words that name none.
BY_HOST = ("personio", "recruitee", "traffit", "breezy")
BY_PATH = ("lever", "greenhouse", "ashby", "workable", "smartrecruiters")
NOISE = ("www", "mail", "smtp", "api", "app", "dev", "staging", "test", "beta", "cdn", "static", "media", "assets", "dashboard", "admin", "portal", "jobs", "careers", "help", "support", "docs", "status")
NO_BOARD = ("test", "demo", "example", "sample", "sandbox", "staging", "career", "careers")
NO_CANDIDATE = ("test", "demo", "example", "sample", "sandbox", "staging")
PAGE_PATTERNS = {
    "greenhouse": r"boards\.greenhouse\.io/(?:embed/job_board\?for=)?([a-zA-Z0-9_-]+)",
    "lever": r"jobs\.lever\.co/([a-zA-Z0-9_-]+)",
    "workable": r"apply\.workable\.com/([a-zA-Z0-9_-]+)",
    "ashby": r"jobs\.ashbyhq\.com/([a-zA-Z0-9_-]+)",
    "personio": r"([a-zA-Z0-9_-]+)\.jobs\.personio\.[a-z]{2,4}",
    "recruitee": r"([a-zA-Z0-9_-]+)\.recruitee\.com",
    "traffit": r"([a-zA-Z0-9_-]+)\.traffit\.com",
    "breezy": r"([a-zA-Z0-9_-]+)\.breezy\.hr",
    "smartrecruiters": r"jobs\.smartrecruiters\.com/([a-zA-Z0-9_-]+)",
    "jobadder": r"app\.jobadder\.com/jobboard/([a-zA-Z0-9_-]+)",
}
HARVEST_PATTERNS = {
    "traffit": r"https?://([a-z0-9][a-z0-9-]{1,62}[a-z0-9])\.traffit\.com",
    "breezy": r"https?://([a-z0-9][a-z0-9-]{1,62}[a-z0-9])\.breezy\.hr",
    "jobadder": r"https?://app\.jobadder\.com/jobboard/([a-zA-Z0-9_-]+)",
    "teamtailor": r"https?://([a-z0-9-]+)\.teamtailor\.com/(?:[a-z]{2}(?:-[A-Z]{2})?/)?jobs(?:/|\b|\?|$)",
}
NOISE_HOSTS = ("www", "jobs", "careers", "career", "app", "api", "admin", "static", "cdn")
SUFFIXES = ("hq", "inc", "labs", "jobs", "app", "careers", "gmbh", "de", "ltd", "uk", "sas", "fr", "spzoo", "pl")
#: Guesses for a name, lines read of a list, points that a harvested slug needs.
GUESSES, LIST_LINES, NEEDED = 30, 5000, 2


def slug_of_address(url: Column, provider: Column) -> Column:
    """A board's slug by its provider's address shape: first host label, or a part of the path."""
    host, path = F.try_parse_url(url, F.lit("HOST")), F.split(F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "^/+|/+$", ""), "/")
    part = lambda i: F.nullif(F.get(path, i), F.lit(""))
    label = F.nullif(F.regexp_extract(host, r"^([^.]+)\.", 1), F.lit(""))
    board = F.when(part(0) == "jobboard", part(1))
    return F.when(host.isNull(), None).when(provider.isin(*BY_HOST), label).when(provider == "jobadder", board).when(provider.isin(*BY_PATH), part(0))


def certificate_slugs(entries: DataFrame, names: str = "name_value") -> DataFrame:
    """Distinct company labels out of certificate names, several to a line."""
    name = F.explode(F.split(text_or_empty(F.col(names)), "\r\n|\n|\r")).alias("name")
    label = F.split(F.regexp_replace(F.lower(strip(F.col("name"))), r"^\*+\.*|^\.+", ""), r"\.")[0]
    return entries.select(name).select(label.alias("slug")).filter(F.col("slug").rlike(r"^[a-z0-9][a-z0-9-]{1,62}[a-z0-9]$") & ~F.col("slug").isin(*NOISE)).distinct()


def valid_slug(slug: Column, words=NO_BOARD) -> Column:
    return (F.length(strip(slug)) >= 3) & ~F.lower(slug).rlike("|".join(words))


def board_of_page(*texts: Column) -> Column:
    """struct(provider, slug): the first text, and in it the first provider, that names a board."""
    found = []
    for text in texts:
        for provider, pattern in PAGE_PATTERNS.items():
            slug = F.nullif(F.regexp_extract(text, f"(?i){pattern}", 1), F.lit(""))
            found.append(F.when(slug.isNotNull(), F.struct(F.lit(provider).alias("provider"), slug.alias("slug"))))
    return F.coalesce(*found)


def harvest(texts: DataFrame, text: str = "text", evidence: str = "evidence") -> DataFrame:
    """(provider, slug, score) of candidates in a company's texts: 2 points for the final address, 1 for
    two finds or more, kept from 2 points on."""
    def candidates(provider: str, pattern: str) -> Column:
        slugs = F.regexp_extract_all(F.col(text), F.lit(f"(?i){pattern}"), 1)
        return F.transform(slugs, lambda slug: F.struct(F.lit(provider).alias("provider"), slug.alias("slug")))

    found = [candidates(*p) for p in HARVEST_PATTERNS.items()]
    rows = texts.select(F.col(evidence).alias("evidence"), F.explode(F.concat(*found)).alias("c")).select("evidence", "c.*")
    rows = rows.filter(valid_slug(F.col("slug"), NO_CANDIDATE) & ~((F.col("provider") == "teamtailor") & F.lower("slug").isin(*NOISE_HOSTS)))
    scored = rows.groupBy("provider", "slug").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("evidence") == "final_url").alias("final"))
    return scored.select("provider", "slug", (F.when(F.col("final"), 2).otherwise(0) + F.when(F.col("n") >= 2, 1).otherwise(0)).alias("score")).filter(F.col("score") >= NEEDED)


def listed_slugs(lines: DataFrame, known: DataFrame, column: str = "value") -> DataFrame:
    """Distinct slugs of a list's first lines, without comments, with those known, in order."""
    clean = lines.select(strip(F.col(column)).alias("slug")).filter((F.col("slug") != "") & ~F.col("slug").startswith("#")).limit(LIST_LINES)
    return clean.union(known.select("slug")).distinct().orderBy("slug")


def guesses(name: Column) -> Column:
    """Slugs that a company of this name may have, likely ones first."""
    lower = F.lower(text_or_empty(name))
    clean = strip(F.regexp_replace(lower, r"\b(inc|llc|ltd|gmbh|corp|co|limited|group)\b\.?", ""))
    clean = F.when(clean == "", lower).otherwise(clean)
    hyphen = F.regexp_replace(F.regexp_replace(F.regexp_replace(clean, r"[^a-z0-9\s_]+", ""), r"[\s_]+", "-"), "^-+|-+$", "")
    bases = F.filter(F.array_distinct(F.array(hyphen, F.regexp_replace(clean, "[^a-z0-9]+", ""))), lambda b: b != "")
    more = F.flatten(F.transform(F.array(*map(F.lit, SUFFIXES)), lambda s: F.flatten(F.transform(bases, lambda b: F.array(F.concat(b, s), F.concat(b, F.lit("-"), s))))))
    return F.slice(F.array_distinct(F.concat(bases, more)), 1, GUESSES)


def passes_gate(jobs_total: Column, remote_hits: Column, recent_at: Column, as_of: str, least_remote: int = 1, days: int = 120) -> Column:
    """A board worth keeping: postings, remote ones among them, and none but recent or unknown times."""
    return (jobs_total >= 1) & (remote_hits >= least_remote) & (recent_at.isNull() | (recent_at >= ago(as_of, days)))


def promotion(provider: Column, passed: Column, has_token: Column) -> Column:
    """What becomes of a pending slug."""
    return F.when((provider == "teamtailor") & ~has_token, "needs_token").when(passed, "promoted").otherwise("rejected")


def companies_of_pages(pages: DataFrame, content: str = "value") -> DataFrame:
    """(name, url) of company pages whose front matter has both; read them with wholetext."""
    field = lambda k: F.nullif(strip(F.regexp_extract(F.col(content), k + r""":\s*["']?([^"'\n]+)""", 1)), F.lit(""))
    return pages.select(field("title").alias("name"), field("website").alias("url")).filter("name IS NOT NULL AND url IS NOT NULL")

"""Decision rules on postings: remote model, hard geography, resolution, taxonomy, currency, quality.

Rules are ordered: the first that fits decides. Lists are matched as parts of the text unless the rule
says between word bounds. Phrase lists and points are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions.columns import let
from vacantia.functions.text import any_part, any_word, one_of, quote, strip, text_or_empty

# Phrases of the remote model.
OFFICE = (
    "relocation required", "on-site", "onsite", "in-office", "in office", "office based", "office-based", "this role is based in", "full-time position in",
    "fully onsite", "fully on-site", "100% onsite", "100% on-site", "in-person", "in person", "work from the office", "return to office", "not a remote",
    "not remote", "#li-onsite", "li-onsite", "office-only", "office only", "no remote", "non-remote",
)
HYBRID = ("hybrid", "days in office", "days a week in the office", "partially remote", "partly remote", "#li-hybrid", "li-hybrid")
REMOTE = (
    "fully remote", "100% remote", "remote only", "remote-only", "remote-first", "remote first", "work from anywhere", "work where you work best",
    "home based", "remote job", "work from home", "#li-remote", "li-remote", "distributed team", "fully distributed",
)
REGION_LOCKED = ("remotely in ", "based remotely", "remote in ", "remotely from ")
OPTIONAL = ("remote work options", "flexible remote", "possibility to work remotely", "flexible working hours and remote", "remote friendly", "remote-friendly")
EVERYWHERE = ("yes", "true", "1", "anywhere", "worldwide")
BENEFIT = r"\bwork from home\s+(?:budget|stipend|allowance|reimbursement|equipment|setup|kit)\b|\bwork from anywhere\s+(?:in the world|globally|worldwide)?\s*(?:\(|for\s+)?up to\b"

# Phrases and patterns that keep a job out of reach.
HARD = (
    "us only", "united states only", "must be located in the us", "must be based in the us", "must reside in the us", "us residents only", "us applicants only",
    "usa-based roles only", "usa based roles only", "must be authorized to work in the us", "us work authorization required", "eligible to work in the us only",
    "americas only", "north america only", "must be located in north america", "must be based in north america", "must reside in north america",
    "south america only", "latam only", "canada only", "us or canada only", "not eligible outside the us", "candidates outside the us will not be considered", "us payroll only",
    "must be eligible to work in the united states", "eligible to work in the united states", "us citizenship required", "us citizen required", "us citizens only",
    "us permanent resident required", "green card required", "must have us work authorization",
    "canadian residents only", "must reside in canada", "must be located in canada", "must be based in canada", "eligible to work in canada only", "canada work authorization required",
    "apac only", "asia pacific only", "must reside in apac", "must be located in apac", "must be based in apac",
    "must reside in asia.?pacific", "must be located in asia.?pacific", "must be based in asia.?pacific", "within apac only",
    "based (?:remotely )?in the apac region", "located (?:remotely )?in the apac region", "remotely in the apac region", "based (?:remotely )?in the asia.?pacific region",
    "australia only", "australian residents only", "must reside in australia", "must be located in australia", "must be based in australia",
    "india only", "indian residents only", "must reside in india", "must be located in india", "must be based in india",
)

#: Geography classes that count as reachable; remote classes; their points. Fixed values.
ELIGIBLE = ("eu_member_state", "eu_explicit", "eu_region", "uk")
MATRIX = {"remote_only": (100, "approved"), "remote_region_locked": (90, "approved"), "remote_optional": (60, "review"), "unknown": (55, "review")}


def hard_geo(text: Column) -> Column:
    return F.lower(text_or_empty(text)).rlike(rf"\b(?:{one_of(HARD, literal=False)})\b")


def remote_model(title: Column, description: Column, scope: Column) -> Column:
    """struct(remote_class, remote_reason)."""
    t, d, s = (F.lower(text_or_empty(c)) for c in (title, description, scope))
    verdict = lambda kind, reason: F.struct(F.lit(kind).alias("remote_class"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("remote_reason"))
    alone = lambda p: rf"(?<![a-z]){p}(?![a-z])"

    # The first strong phrase of the scope, or just `remote`, and what the scope says beyond it.
    phrase = F.get(F.filter(F.array(*map(F.lit, REMOTE)), lambda p: s.contains(p)), 0)
    keyword = F.coalesce(phrase, F.when(s.contains("remote"), F.lit("remote")))
    own = F.when(phrase.isNull(), F.lit("remote(?:ly)?")).otherwise(F.concat(F.lit("\\Q"), phrase, F.lit("\\E")))
    rest = strip(F.translate(F.regexp_replace(s, F.concat(F.lit("(?<![a-z])"), own, F.lit("(?![a-z])")), F.lit("")), "-,", ""))
    region = (rest != "") & ~rest.isin(*EVERYWHERE)

    bounded = lambda phrases: d.rlike(alone("(?:" + one_of(phrases) + ")"))
    strong = bounded([p for p in REMOTE if p != "work from home"]) | (bounded(["work from home"]) & ~d.rlike("(?i)" + BENEFIT))
    away = OFFICE + HYBRID
    return (
        F.when(any_part(s, away), verdict("non_remote", "scope_negative_or_hybrid"))
        .when(any_part(t, away), verdict("non_remote", "title_negative_or_hybrid"))
        .when(any_part(t, OPTIONAL) | any_part(s, OPTIONAL), verdict("remote_optional", "title_or_scope_optional"))
        .when(keyword.isNotNull() & region, verdict("remote_region_locked", "scope_region"))
        .when(keyword.isNotNull(), verdict("remote_only", F.concat(F.lit("scope_"), F.replace(keyword, F.lit(" "), F.lit("_")))))
        .when(any_part(t, REMOTE), verdict("remote_only", "title_remote_strong"))
        .when(any_part(d, OFFICE), verdict("non_remote", "desc_negative"))
        .when(any_part(d, HYBRID), verdict("non_remote", "hybrid_signal"))
        .when(t.contains("remote"), verdict("remote_only", "title_remote"))
        .when(strong, verdict("remote_only", "desc_remote_strong"))
        .when(any_part(d, REGION_LOCKED), verdict("remote_region_locked", "desc_remote_region_locked"))
        .when(any_part(d, OPTIONAL), verdict("remote_optional", "benefit_remote"))
        .otherwise(verdict("unknown", "no_signal"))
    )


def is_region_locked(scope: Column) -> Column:
    s = F.lower(text_or_empty(scope))
    rest = strip(F.replace(F.regexp_replace(s, r"(?<![a-z])remote(?:ly)?(?![a-z])", ""), F.lit(","), F.lit("")))
    return s.contains("remote") & (rest != "")


def remote_model_simple(title: Column, description: Column, scope: Column) -> Column:
    """The older model: struct(remote_model, confidence)."""
    text = F.concat_ws(" ", *(F.lower(text_or_empty(c)) for c in (title, description, scope)))
    verdict = lambda kind, sure: F.struct(F.lit(kind).alias("remote_model"), F.lit(sure).alias("confidence"))
    return (
        F.when(any_part(text, OFFICE), verdict("office_first", 0.95))
        .when(any_part(text, HYBRID), verdict("hybrid", 0.85))
        .when(is_region_locked(scope), verdict("remote_but_geo_restricted", 0.8))
        .when(any_part(text, REGION_LOCKED), verdict("remote_region_locked", 0.85))
        .when(any_part(text, REMOTE), verdict("remote_only", 0.9))
        .when(any_part(text, OPTIONAL), verdict("remote_optional", 0.7))
        .otherwise(verdict("unknown", 0.3))
    )


def resolution(remote_class: Column, geo_class: Column) -> Column:
    """struct(compliance_score, compliance_status) of a remote and a geography class."""
    remote, geo = F.coalesce(F.lower(remote_class), F.lit("unknown")), F.coalesce(F.lower(geo_class), F.lit("unknown"))
    verdict = lambda score, status: F.struct(F.lit(score).alias("compliance_score"), F.lit(status).alias("compliance_status"))
    out = F.when((remote == "non_remote") | (geo == "non_eu"), verdict(0, "rejected"))
    for kind, (score, status) in MATRIX.items():
        out = out.when((remote == kind) & geo.isin(*ELIGIBLE), verdict(score, status))
    return out.otherwise(verdict(20, "rejected"))


# Taxonomy rules, in order.
FAMILIES = (
    (("hr", "recruiter", "talent"), "hr"),
    (("designer", "ux", "ui"), "design"),
    (("operations", "support", "office"), "operations"),
    (("product manager", "product owner"), "product_management"),
    (("marketing", "growth", "seo", "content"), "marketing"),
    (("sales", "account executive", "business development"), "sales"),
    (("finance", "accounting", "financial"), "finance"),
    (("developer", "development", "engineer", "engineering", "software", "backend", "frontend", "fullstack"), "software_development"),
    (("data scientist", "data"), "data_science"),
    (("design",), "design"),
)
ROLES = {
    "software_development": ((("engineer", "engineering"), "engineer"), (("developer", "development"), "developer")),
    "data_science": ((("data scientist", "analyst", "machine learning"), "data_scientist"),),
    "design": ((("ux", "ui", "designer"), "designer"),),
    "product_management": ((("product manager", "product owner"), "product_manager"),),
    "marketing": ((("marketing", "seo", "growth"), "marketing_specialist"),),
    "sales": ((("sales", "account"), "sales_representative"),),
    "hr": ((("recruiter", "hr"), "hr_specialist"),),
    "finance": ((("finance", "accounting"), "finance_analyst"),),
    "operations": ((("operations", "support"), "operations_manager"),),
}
SENIORITIES = (
    (("ceo", "cto", "cfo", "chief"), "executive"),
    (("director", "vp", "head", "manager"), "manager"),
    (("senior", "lead", "principal", "staff"), "senior"),
    (("junior", "associate", "intern"), "junior"),
)
SPECIALIZATIONS = (
    (("devsecops",), "devsecops"),
    (("devops", "kubernetes", "terraform", "aws", "gcp", "azure"), "devops"),
    (("site reliability", "sre"), "sre"),
    (("platform", "infrastructure", "cloud"), "platform"),
    (("backend",), "backend"),
    (("frontend",), "frontend"),
    (("fullstack", "full stack"), "fullstack"),
    (("machine learning", "ml"), "machine_learning"),
    (("data",), "data"),
    (("ios", "android", "mobile"), "mobile"),
)
SYNONYMS = (
    ("site reliability engineer", "sre"),
    ("site reliability", "sre"),
    ("platform engineer", "platform"),
    ("platform engineering", "platform"),
    ("cloud engineer", "cloud"),
    ("cloud infrastructure", "cloud"),
    ("infrastructure engineer", "infrastructure"),
    ("dev sec ops", "devsecops"),
    ("dev-sec-ops", "devsecops"),
    ("full stack", "fullstack"),
    ("front end", "frontend"),
    ("back end", "backend"),
)


def _first_rule(text: Column, rules) -> Column:
    """The result of the first rule of which some word stands in the text, else `unknown`."""
    out = F.lit("unknown")
    for words, result in reversed(rules):
        out = F.when(any_word(text, words, ""), F.lit(result)).otherwise(out)
    return out


def taxonomy(title: Column, department: Column | None = None) -> Column:
    """struct(job_family, job_role, seniority, specialization): the department decides the family before
    the title does; the role depends on the family."""
    texts = {"t": F.lower(text_or_empty(title))} | ({} if department is None else {"d": F.lower(text_or_empty(department))})

    def read(x: Column) -> Column:
        family, plain = _first_rule(x["t"], FAMILIES), x["t"]
        if department is not None:
            family = let(_first_rule(x["d"], FAMILIES), lambda d: F.when(d != "unknown", d).otherwise(_first_rule(x["t"], FAMILIES)))
        for source, target in SYNONYMS:
            plain = F.regexp_replace(plain, rf"\b{quote(source)}\b", target)
        return let(F.struct(x["t"].alias("t"), family.alias("family"), plain.alias("plain")), named)

    def named(x: Column) -> Column:
        family, role = x["family"], F.lit("unknown")
        for name, rules in ROLES.items():
            role = F.when(family == name, _first_rule(x["t"], rules)).otherwise(role)
        return F.struct(family.alias("job_family"), role.alias("job_role"), _first_rule(x["t"], SENIORITIES).alias("seniority"), _first_rule(x["plain"], SPECIALIZATIONS).alias("specialization"))

    return let(F.struct(*[c.alias(n) for n, c in texts.items()]), read)


# Currency marks in order (as parts of the text), and euros for one unit.
CURRENCY_MARKS = {
    "€": "EUR", "eur": "EUR", "euro": "EUR", "$": "USD", "usd": "USD", "dollar": "USD", "£": "GBP", "gbp": "GBP", "pound": "GBP", "pln": "PLN", "złoty": "PLN",
    "zloty": "PLN", "zł": "PLN", "chf": "CHF", "franc": "CHF", "sek": "SEK", "nok": "NOK", "dkk": "DKK", "czk": "CZK", "huf": "HUF", "ron": "RON", "bgn": "BGN",
}
EUROS = {"EUR": 1.0, "USD": 0.92, "GBP": 1.17, "PLN": 0.23, "CHF": 1.03, "SEK": 0.09, "NOK": 0.09, "DKK": 0.13, "CZK": 0.04, "HUF": 0.0025, "RON": 0.20, "BGN": 0.51}
#: Statements that salaries are talked about later. Fixed values.
TRANSPARENCY = ("salary will be discussed", "compensation will be discussed", "salary range will be shared", "compensation discussed during interview", "salary determined based on experience")
#: Specializations that raise a posting's quality. Fixed values.
TECHNICAL = ("backend", "frontend", "fullstack", "devops", "sre", "platform", "machine_learning")


def currency(text: Column) -> Column:
    return let(F.lower(text_or_empty(text)), lambda t: F.coalesce(*[F.when(t.contains(mark), F.lit(code)) for mark, code in CURRENCY_MARKS.items()]))


def in_euros(amount: Column, code: Column) -> Column:
    """NULL for no amount, an amount of 0, or an unknown currency."""
    rates = F.create_map(*[F.lit(x) for pair in EUROS.items() for x in pair])
    return F.nullif(amount.cast("double"), F.lit(0.0)) * F.try_element_at(rates, F.upper(code))


def transparency(description: Column, detected: Column) -> Column:
    d = F.lower(text_or_empty(description))
    return F.when(detected, "disclosed").when(d == "", "unknown").when(any_part(d, TRANSPARENCY), "transparent_statement").otherwise("not_disclosed")


def quality_score(seniority: Column, specialization: Column, description: Column, salary_min: Column, source: Column) -> Column:
    points = F.when(seniority == "senior", 25).when(seniority == "manager", 20).when(seniority == "junior", 5).otherwise(0)
    flags = ((specialization.isin(*TECHNICAL), 20), (salary_min != 0, 15), (F.length(text_or_empty(description)) > 800, 10), (source == "greenhouse", 5))
    for condition, worth in flags:
        points = points + F.when(condition, worth).otherwise(0)
    return points


def ats_salary(pay: Column) -> Column:
    """Salary fields of a posting's pay given as a map of texts: the first key that is set counts, whole
    numbers, the period as a word."""
    key = lambda *names: F.coalesce(*[F.try_element_at(pay, F.lit(n)) for n in names])
    whole = lambda c: c.try_cast("double").cast("int")
    low, high = whole(key("minAmount", "min_value", "min")), whole(key("maxAmount", "max_value", "max"))
    unit = F.lower(F.coalesce(key("interval", "period", "unit", "type"), F.lit("")))
    period = F.when(unit.rlike("year|annu"), "yearly").when(unit.contains("month"), "monthly").when(unit.contains("hour"), "hourly")
    code = F.nullif(F.upper(F.trim(key("currencyCode", "currency"))), F.lit(""))
    return F.struct(low.alias("salary_min"), high.alias("salary_max"), code.alias("salary_currency"), period.alias("salary_period"), F.when(low.isNotNull() | high.isNotNull(), "ats_api").alias("salary_source"))


#: Older names of classes. Fixed values.
OLD_REMOTE = {"remote_but_geo_restricted": "remote_region_locked", "hybrid": "non_remote", "office_first": "non_remote"}
OLD_GEO = {"eog": "eu_region", "worldwide": "unknown", "global": "unknown", "eu_friendly": "unknown", "non_eu_restricted": "non_eu"}
REMOTE_CLASSES = ("remote_only", "remote_region_locked", "remote_optional", "non_remote", "unknown")
GEO_CLASSES = ("eu_member_state", "eu_explicit", "eu_region", "uk", "non_eu", "unknown")


def _class_name(value: Column, old: dict[str, str], known: tuple[str, ...]) -> Column:
    name = strip(F.lower(text_or_empty(value)))
    renamed = F.try_element_at(F.create_map(*[F.lit(x) for pair in old.items() for x in pair]), name)
    return F.coalesce(renamed, F.when(name.isin(*known), name), F.lit("unknown"))


def remote_class_name(value: Column) -> Column:
    return _class_name(value, OLD_REMOTE, REMOTE_CLASSES)


def geo_class_name(value: Column) -> Column:
    return _class_name(value, OLD_GEO, GEO_CLASSES)

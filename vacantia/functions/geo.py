"""Where a posting may be done from, out of its scope, title and description, as column expressions.

The scope and the title are read token by token; region names and phrases follow, then the
description's localization section and its phrases. The word lists are fixed values, in order: the
first that fits gives the reason.
"""

from __future__ import annotations

import hashlib
import inspect
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions import classify
from vacantia.functions.classify import hard_geo, remote_model, resolution
from vacantia.functions.columns import let as _let
from vacantia.functions.text import collapse, one_of, strip, text_or_empty, unescaped

# Fixed values.
MEMBERS = [
    "austria", "belgium", "bulgaria", "croatia", "cyprus", "czechia", "czech republic", "denmark", "estonia", "finland", "france", "germany", "greece", "hungary", "ireland",
    "italy", "latvia", "lithuania", "luxembourg", "malta", "netherlands", "poland", "portugal", "romania", "slovakia", "slovenia", "spain", "sweden",
]
EEA = ["norway", "iceland", "liechtenstein"]
UK = ["united kingdom", "uk only", "uk-based", "uk based", "britain", "london", "england", "scotland", "wales", "northern ireland"]
EU_REGIONS = ["emea", "western europe", "nordics", "benelux", "dach", "uk&i", "uk & ireland", "uk and ireland"]
EU_WORDS = ["europe", "within eu", "eu-wide", "eu wide", "europe-wide", "europe wide", "europe only", "european economic area", "eea", "european union", "iberia"]
OTHER_REGIONS = ["americas", "north america", "latam", "apac", "africa", "sub-saharan africa", "west africa", "east africa", "southern africa", "central africa", "north africa"]
GLOBAL_WORDS = ["north america", "americas", "asia pacific", "apac"]
UK_PHRASES = ["uk only", "uk-based", "uk based", "remote in the uk", "remote uk", "remotely in the uk"]
TIMEZONES = ["cet", "cest", "utc+1", "utc +1", "utc+2", "utc +2"]
OTHER_TOKENS = ["us", "usa", "canada"]
STATES = [
    "al", "ak", "az", "ar", "ca", "co", "ct", "dc", "de", "fl", "ga", "ia", "id", "il", "ks", "ky", "la", "ma", "md", "mi", "mn", "mo", "ms", "mt", "nc", "nd", "ne", "nh", "nj", "nm", "nv", "ny", "oh", "ok", "pa", "ri", "sc", "sd", "tn", "tx", "ut", "va", "vt", "wa", "wi", "wv", "wy",
]
US_PHRASES = [
    "united states only", "usa only", "u.s. only", "us only", "remote us", "remote in the us", "remote within the us", "remote within united states", "us-based only", "us based only",
    "u.s.-based only", "must live in the us", "must be in the us", "must reside in the us", "must be based in the us", "must be us-based", "us residents only",
    "within the united states", "within united states", "u.s.-based", "us-based", "usa-based", "usa based", "united states", "u.s.", "usa",
]
# Names, codes and large cities, and the member or EEA state that they stand for.
ALIASES = {
    "deutschland": "germany", "de": "germany", "fr": "france", "nl": "netherlands", "niederlande": "netherlands", "es": "spain", "spanien": "spain", "it": "italy", "italien": "italy",
    "ie": "ireland", "irland": "ireland", "pl": "poland", "polen": "poland", "pt": "portugal", "belgia": "belgium", "belgique": "belgium", "belgien": "belgium", "austria": "austria",
    "österreich": "austria", "at": "austria", "cz": "czech republic", "czechia": "czech republic", "slovakia": "slovakia", "slovensko": "slovakia", "sk": "slovakia",
    "berlin": "germany", "munich": "germany", "münchen": "germany", "hamburg": "germany", "frankfurt": "germany", "paris": "france", "lyon": "france", "marseille": "france",
    "toulouse": "france", "madrid": "spain", "barcelona": "spain", "valencia": "spain", "seville": "spain", "rome": "italy", "milan": "italy", "naples": "italy", "turin": "italy",
    "warsaw": "poland", "warszawa": "poland", "krakow": "poland", "kraków": "poland", "wroclaw": "poland", "wrocław": "poland", "amsterdam": "netherlands", "rotterdam": "netherlands",
    "the hague": "netherlands", "utrecht": "netherlands", "stockholm": "sweden", "gothenburg": "sweden", "malmo": "sweden", "malmö": "sweden", "dublin": "ireland", "cork": "ireland",
    "galway": "ireland", "lisbon": "portugal", "porto": "portugal", "braga": "portugal", "vienna": "austria", "wien": "austria", "salzburg": "austria", "linz": "austria",
    "brussels": "belgium", "antwerp": "belgium", "ghent": "belgium", "prague": "czech republic", "praha": "czech republic", "brno": "czech republic", "ostrava": "czech republic",
    "bucharest": "romania", "cluj-napoca": "romania", "timisoara": "romania", "athens": "greece", "thessaloniki": "greece", "patras": "greece", "budapest": "hungary",
    "debrecen": "hungary", "szeged": "hungary", "copenhagen": "denmark", "aarhus": "denmark", "odense": "denmark", "helsinki": "finland", "espoo": "finland", "tampere": "finland",
    "bratislava": "slovakia", "kosice": "slovakia", "sofia": "bulgaria", "plovdiv": "bulgaria", "varna": "bulgaria", "riga": "latvia", "tallinn": "estonia", "vilnius": "lithuania",
    "zagreb": "croatia", "dubrovnik": "croatia", "ljubljana": "slovenia", "nicosia": "cyprus", "valletta": "malta", "oslo": "norway", "bergen": "norway", "reykjavik": "iceland",
}
OTHER_PLACES = [
    "united states", "us only", "u.s.", "usa", "canada",
    "bahrain", "iraq", "israel", "jordan", "kuwait", "lebanon", "oman", "palestine", "qatar", "saudi arabia", "syria", "turkey", "united arab emirates", "yemen",
    "algeria", "egypt", "libya", "morocco", "tunisia", "western sahara",
    "angola", "benin", "botswana", "burkina faso", "burundi", "cabo verde", "cameroon", "central african republic", "chad", "comoros", "congo", "democratic republic of the congo",
    "djibouti", "equatorial guinea", "eritrea", "eswatini", "ethiopia", "gabon", "gambia", "ghana", "guinea", "guinea-bissau", "ivory coast", "kenya", "lesotho", "liberia", "madagascar",
    "malawi", "mali", "mauritania", "mauritius", "mozambique", "namibia", "niger", "nigeria", "rwanda", "sao tome and principe", "senegal", "seychelles", "sierra leone", "somalia",
    "south africa", "south sudan", "sudan", "tanzania", "togo", "uganda", "zambia", "zimbabwe",
    "australia", "new zealand", "philippines", "india", "singapore", "hong kong", "japan", "south korea", "malaysia", "indonesia", "thailand", "vietnam", "bangladesh", "pakistan",
    "myanmar", "cambodia", "sri lanka",
    "mexico", "brazil", "argentina", "colombia", "chile", "peru", "venezuela", "ecuador", "bolivia", "paraguay", "uruguay", "costa rica", "panama", "guatemala", "cuba", "dominican republic",
    "russia", "uzbekistan", "kazakhstan",
    "san francisco", "new york", "los angeles", "chicago", "seattle", "austin", "boston", "denver", "atlanta", "miami", "dallas", "houston", "san diego", "phoenix", "portland",
    "minneapolis", "philadelphia", "pittsburgh", "nashville", "charlotte", "detroit", "raleigh", "salt lake city", "las vegas", "brooklyn", "manhattan", "san jose", "palo alto",
    "menlo park", "mountain view", "sunnyvale", "san mateo", "bellevue", "redmond", "nyc",
]


def _alone(phrases) -> str:
    return r"(?<![a-z0-9])(?:" + one_of(phrases) + r")(?![a-z0-9])"


def _has(text: Column, phrases) -> Column:
    return text.rlike(_alone(phrases))


def _first(text: Column, phrases, *more: Column) -> Column:
    """The first phrase in the list's order that stands alone in the text (or in one of more), or NULL.

    One pass of one constant pattern over a text: where a word may begin, it looks ahead for the phrases in
    the list's order, so that of those that begin there it names the first, and hides none that begins later.
    """
    pattern = F.lit(r"(?<![a-z0-9])(?=(" + one_of(phrases) + r")(?![a-z0-9]))")
    found = [F.regexp_extract_all(t, pattern, 1) for t in (text, *more)]
    found = F.concat(*found) if more else found[0]
    listed = F.array(*map(F.lit, phrases))
    return F.when(text.rlike(_alone(phrases)) if not more else F.lit(True), F.get(listed, (F.array_min(F.transform(found, lambda p: F.array_position(listed, p))) - 1).cast("int")))


def _first_part(texts: list[Column], phrases) -> Column:
    return F.coalesce(*[F.when(texts[0].contains(p) | texts[1].contains(p), F.lit(p)) for p in phrases])


def _token(column: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(F.lower(column)), r"^[()]+|[()]+$", ""), r"\.+$", "")


def _pieces(column: Column, pattern: str) -> Column:
    return F.transform(F.filter(F.split(column, pattern), lambda p: strip(p) != ""), _token)


def places(text: Column) -> Column:
    """struct(eu, other, members) of a lower-case scope or title, token by token. A state code goes
    before a country code; within a longer token two letters name no country."""
    here, alias = [*MEMBERS, *EEA], list(ALIASES)

    def part(p: Column) -> Column:
        return F.when(p.isin(*STATES) | p.isin(*OTHER_TOKENS), "other").when(p.isin(*alias), F.when(F.length(p) > 2, "member").otherwise("")).when(p.isin(*here), "member").otherwise("")

    def token(t: Column) -> Column:
        whole = F.when(t.isin(*STATES), "other").when(t.isin(*alias) | t.isin(*here), "member").when(t.isin(*UK), "uk")
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(_pieces(t, r"[\s:\-]+"), part))

    kinds = F.flatten(F.transform(_pieces(text, "[;,/]+"), token))
    members = F.size(F.filter(kinds, lambda k: k == "member"))
    other = F.array_contains(kinds, "other") | _has(text, [*OTHER_PLACES, *US_PHRASES])
    return F.struct(((members > 0) | F.array_contains(kinds, "uk")).alias("eu"), other.alias("other"), members.alias("members"))


def localization(description: Column) -> Column:
    """The text of a description's localization section, in lower case; empty without one. Below a heading,
    empty lines before the first text don't count."""
    html = F.regexp_extract(description, r"(?is)<h[1-6][^>]*>\s*locali[sz]ation\s*:?\s*</h[1-6]>\s*(.*?)(?=<h[1-6][^>]*>|$(?!\n))", 1)
    inline = F.regexp_extract(description, r"(?im)^[ \t]*(?:#{1,6}[ \t]*)?locali[sz]ation[ \t]*:[ \t]*(\S.*)$", 1)
    below = F.regexp_extract(description, r"(?im)^[ \t]*(?:#{1,6}[ \t]*)?locali[sz]ation[ \t]*:?[ \t]*\n(?:[ \t]*\n)*((?:(?![ \t]*#{1,6}[ \t]+\S)(?![ \t]*[A-Za-z][A-Za-z0-9 /&()+-]{1,60}[ \t]*:[ \t]*$)[ \t]*\S.*\n?)+)", 1)
    return F.lower(F.when(html != "", collapse(unescaped(F.regexp_replace(html, "<[^>]+>", " ")))).when(inline != "", collapse(inline)).otherwise(collapse(below)))


def geography(title: Column, description: Column, scope: Column) -> Column:
    """struct(geo_class, geo_reason). What scope and title say comes first; the description is only read where
    they say nothing, list by list, and each list only where none before it has a phrase."""
    verdict = lambda kind, reason: F.struct(F.lit(kind).alias("geo_class"), (reason if isinstance(reason, Column) else F.lit(reason)).cast("string").alias("geo_reason"))
    t, d, s = (F.lower(text_or_empty(c)) for c in (title, description, scope))
    texts = F.struct(t.alias("t"), d.alias("d"), s.alias("s"), text_or_empty(description).alias("description"))

    def by_place(x: Column) -> Column:
        both = F.struct(places(x["s"]).alias("scope"), places(x["t"]).alias("title"), _first_part([x["s"], x["t"]], EU_REGIONS).alias("region"), _first_part([x["s"], x["t"]], OTHER_REGIONS).alias("away"), (_has(x["s"], OTHER_PLACES) | _has(x["t"], OTHER_PLACES)).alias("phrase"))
        return F.coalesce(_let(both, lambda p: decided(x, p)), by_description(x))

    def decided(x: Column, p: Column) -> Column:
        scoped, titled, region, away, phrase = p["scope"], p["title"], p["region"], p["away"], p["phrase"]
        eu_place = scoped["eu"] | titled["eu"]
        eu = eu_place | region.isNotNull()
        explicit = (scoped["other"] & ~scoped["eu"]) | (titled["other"] & ~titled["eu"])
        other = (scoped["eu"] & scoped["other"]) | (titled["eu"] & titled["other"]) | explicit | away.isNotNull() | phrase
        place = _first(x["s"], OTHER_PLACES, x["t"])
        return (
            F.when(eu & other & phrase & (scoped["members"] < 1), verdict("non_eu", F.coalesce(place, away)))
            .when(eu & other, verdict("eu_region", "mixed_region"))
            .when(eu_place, verdict("eu_member_state", "explicit_country"))
            .when(eu, verdict("eu_region", region))
            .when(other, verdict("non_eu", F.when(explicit, F.lit("explicit_country")).otherwise(F.coalesce(away, place))))
        )

    long = [a for a in ALIASES if len(a) > 2]
    countries = F.create_map(*[F.lit(x) for a in long for x in (a, ALIASES[a])])
    found = lambda text, phrases, kind, make=lambda w: w, unless=None: _let(_first(text, phrases), lambda w: F.when(w.isNotNull() if unless is None else w.isNotNull() & ~unless, verdict(kind, make(w))))
    described = lambda w: F.concat(F.lit("desc_"), F.replace(w, F.lit(" "), F.lit("_")))
    under = lambda w: F.concat(F.lit("desc_"), F.replace(F.replace(w, F.lit(" & "), F.lit("_")), F.lit(" "), F.lit("_")))

    def by_section(section: Column) -> Column:
        country = lambda a: F.try_element_at(countries, a)
        by_alias = _let(country(_first(section, long)), lambda c: F.when(c.isin(*MEMBERS), verdict("eu_member_state", c)).when(c.isNotNull(), verdict("eu_region", c)))
        return F.when(section != "", F.coalesce(found(section, MEMBERS, "eu_member_state"), found(section, EEA, "eu_region"), by_alias, found(section, UK, "uk")))

    def by_description(x: Column) -> Column:
        d = x["d"]
        return F.coalesce(
            F.when(d.rlike("locali[sz]ation"), _let(localization(x["description"]), by_section)),
            found(d, EU_WORDS, "eu_region", described, _has(d, GLOBAL_WORDS)),
            found(d, EU_REGIONS, "eu_region", under, _has(d, OTHER_REGIONS)),
            found(d, UK_PHRASES, "uk", described),
            found(d, TIMEZONES, "eu_region", lambda w: F.concat(F.lit("desc_timezone_"), F.replace(w, F.lit(" "), F.lit("")))),
            found(F.concat_ws(" ", x["t"], x["s"]), UK, "uk"),
            verdict("unknown", None),
        )

    return _let(texts, by_place)


def policy(jobs, title="title", description="description", scope="remote_scope"):
    """jobs with remote_class, geo_class, their reasons, compliance_score, compliance_status and
    policy_reason. A hard restriction decides at once. Each classifier is a column of its own, so that
    no expression is worked out twice."""
    t, d, s = F.col(title), F.col(description), F.col(scope)
    hard = hard_geo(F.concat_ws(" ", text_or_empty(t), text_or_empty(d), text_or_empty(s)))
    out = jobs.withColumn("__hard", hard).withColumn("__remote", remote_model(t, d, s)).withColumn("__geo", geography(t, d, s))
    out = out.withColumn("__verdict", resolution(F.col("__remote.remote_class"), F.col("__geo.geo_class")))
    pick = lambda value, instead: F.when(F.col("__hard"), F.lit(instead)).otherwise(F.col(value))
    columns = {
        "remote_class": pick("__remote.remote_class", "unknown"),
        "geo_class": pick("__geo.geo_class", "non_eu"),
        "remote_reason": pick("__remote.remote_reason", None),
        "geo_reason": pick("__geo.geo_reason", None),
        "compliance_score": pick("__verdict.compliance_score", 0),
        "compliance_status": pick("__verdict.compliance_status", "rejected"),
        "policy_reason": F.when(F.col("__hard"), "geo_restriction_hard"),
        "decision_trace": decision_trace(F.col("__hard"), F.col("__remote"), F.col("__geo"), F.col("__verdict")),
    }
    return out.withColumns(columns).drop("__hard", "__remote", "__geo", "__verdict")


#: A step of a decision: what it asked, what came out, and for the scoring what speaks against the posting.
TRACE = "array<struct<step:string,result:string,reason:string,score:int,penalties:array<string>,bonuses:array<string>,status:string>>"


def decision_trace(hard: Column, remote: Column, place: Column, verdict: Column) -> Column:
    """The steps of a decision in order. A hard restriction ends it at its first step; otherwise the classes,
    the score with the classes that speak against the posting, and the resolution follow."""
    fields = {"step": "string", "result": "string", "reason": "string", "score": "int", "penalties": "array<string>", "bonuses": "array<string>", "status": "string"}
    step = lambda **given: F.struct(*[(given[k] if k in given else F.lit(None)).cast(kind).alias(k) for k, kind in fields.items()])
    first = step(step=F.lit("hard_geo_check"), result=hard)
    against = F.array_compact(F.array(F.when(remote["remote_class"] != "remote_only", remote["remote_class"]), F.when(~place["geo_class"].isin("eu_member_state", "eu_explicit"), place["geo_class"])))
    rest = [
        step(step=F.lit("remote_classifier"), result=remote["remote_class"], reason=remote["remote_reason"]),
        step(step=F.lit("geo_classifier"), result=place["geo_class"], reason=place["geo_reason"]),
        step(step=F.lit("scoring"), score=verdict["compliance_score"], penalties=against, bonuses=F.array().cast("array<string>")),
        step(step=F.lit("resolver"), status=verdict["compliance_status"]),
    ]
    return F.when(hard, F.array(first)).otherwise(F.array(first, *rest))


def scoring_step(trace: Column) -> Column:
    """The `scoring` step of a decision trace (array of structs with a step), NULL without one."""
    return F.get(F.filter(trace, lambda s: s["step"] == "scoring"), 0)


#: Modules whose text decides a resolution: rules and tables of geography and classes, and the text functions they use.
_POLICY = (classify.__name__, __name__, text_or_empty.__module__)


def policy_version() -> str:
    """`v4.` and a digest of the rules' source, so that a changed rule or table is another version."""
    digest = hashlib.md5()
    for name in _POLICY:
        digest.update(inspect.getsource(sys.modules[name]).encode())
    return "v4." + digest.hexdigest()[:7]


# Phrases of the older scope, by place, after those of the United States.
CANADA_PHRASES = ["canada only", "canadian residents only", "remote canada", "remote in canada", "canada-based", "canada based", "must live in canada", "must be based in canada", "must reside in canada", "within canada", "canada"]
APAC_PHRASES = ["apac only", "within apac", "asia pacific", "apac"]
AUSTRALIA_PHRASES = ["australia only", "australia-based", "australia based", "must live in australia", "within australia", "australia"]
INDIA_PHRASES = ["india only", "india-based", "india based", "must live in india", "within india", "india"]
LATAM_PHRASES = ["latam only", "within latam", "latin america", "latam"]
FAR_PHRASES = [*US_PHRASES, *CANADA_PHRASES, *APAC_PHRASES, *AUSTRALIA_PHRASES, *INDIA_PHRASES, *LATAM_PHRASES, "north america only"]
#: Different state codes that make a text American.
STATES_NEEDED = 3


def geography_of_text(title: Column, description: Column) -> Column:
    """The older scope, from title and description as one text: struct(geo_class, matched_keyword)."""
    text = F.lower(F.concat_ws(" ", text_or_empty(title), text_or_empty(description)))
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(" + "|".join(STATES) + r")\b"), 1))
    verdict = lambda kind, word: F.struct(F.lit(kind).alias("geo_class"), (word if isinstance(word, Column) else F.lit(word)).cast("string").alias("matched_keyword"))
    out = F.when(_has(text, FAR_PHRASES), verdict("non_eu", _first(text, FAR_PHRASES)))
    out = out.when(F.size(codes) >= STATES_NEEDED, verdict("non_eu", f"us_state_codes>={STATES_NEEDED}")).when(_has(text, ["eu only", "eu-only", "european union"]), verdict("eu_explicit", "eu"))
    for kind, words in (("eu_member_state", MEMBERS), ("eu_region", EEA), ("eu_region", EU_WORDS), ("uk", UK)):
        out = out.when(_has(text, words), verdict(kind, _first(text, words)))
    return out.when(text.rlike(r"\buk\b"), verdict("uk", "uk")).otherwise(verdict("unknown", None))

"""Job boards: landed payloads (slug, payload JSON) as canonical postings.

A provider is a schema for its payload and a projection of it; both are declared here, and a payload
that doesn't parse has NULL fields and drops out like any posting without an id, title or address.
Reading is Spark's: land the boards' answers as files, read them as text or JSON, and normalise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import text as x
from vacantia.functions.classify import ats_salary
from vacantia.functions.columns import let, now

PAY = "map<string,string>"


def _col(name: str) -> Column:
    return F.col(f"p.`{name}`") if "." not in name else F.col(f"p.{name}")


def _stripped(column: Column) -> Column:
    return x.strip(x.text_or_empty(column))


def _filled(column: Column) -> Column:
    return F.nullif(_stripped(column), F.lit(""))


def _says_remote(location: Column) -> Column:
    return F.lower(x.text_or_empty(location)).contains("remote")


def _slug_name() -> Column:
    return x.title_from_slug(x.strip(F.col("slug")))


def _posting(provider: str, *, id: Column, title: Column, url: Column, location: Column, description: Column, seen: Column, scope: Column | None = None, company: Column | None = None, department: Column | None = None, flag: Column | None = None, words: Column | None = None, pay: Column | None = None) -> dict[str, Column]:
    """The canonical columns; location decides scope and remote flag where the provider has no better."""
    salary = ats_salary(pay if pay is not None else F.lit(None).cast(PAY))
    source = F.concat(F.lit(f"{provider}:"), "slug")
    return {
        "job_id": F.concat(source, F.lit(":"), id.cast("string")),
        "source": source,
        "source_job_id": id.cast("string"),
        "source_url": url,
        "title": _stripped(title),
        "company_name": F.coalesce(_filled(company) if company is not None else F.lit(None), _slug_name()),
        "description": _stripped(description),
        "remote_source_flag": x.detects_remote(title, location, flag if flag is not None else _says_remote(location), words),
        "remote_scope": x.canonical_scope(scope if scope is not None else location),
        "department": F.nullif(department, F.lit("")) if department is not None else F.lit(None).cast("string"),
        "status": F.lit("new"),
        "first_seen_at": x.moment(seen),
        "salary_min": salary["salary_min"],
        "salary_max": salary["salary_max"],
        "salary_currency": salary["salary_currency"],
        "salary_period": salary["salary_period"],
        "salary_source": salary["salary_source"],
    }


def _headed(items: Column, heading: str, body: str) -> Column:
    """Items of an array that have a body, under their headings."""
    kept = F.filter(items, lambda i: F.coalesce(i[body], F.lit("")) != "")
    return F.array_join(F.transform(kept, lambda i: F.concat(F.when(F.coalesce(i[heading], F.lit("")) != "", F.concat(F.lit("<h3>"), i[heading], F.lit("</h3>\n"))).otherwise(""), i[body])), "\n\n")


def _greenhouse() -> dict[str, Column]:
    place = x.clean_location(_col("location.name"))
    return _posting("greenhouse", id=_col("id"), title=_col("title"), url=x.clean_url(_col("absolute_url")), location=place, description=F.coalesce(_filled(_col("content")), _col("description")), seen=F.coalesce(_col("updated_at"), _col("pubDate")), company=F.coalesce(_filled(_col("company_name")), _col("company")), department=F.get(_col("departments"), 0)["name"], pay=F.get(_col("pay_bounds"), 0))


def _lever() -> dict[str, Column]:
    place = x.clean_location(_col("categories.location"))
    kind = x.text_or_empty(_col("workplaceType"))
    main, more = F.coalesce(_filled(_col("description")), _filled(_col("descriptionPlain"))), F.coalesce(_filled(_col("additional")), _filled(_col("additionalPlain")))
    body = F.concat_ws("\n\n", main, F.nullif(_headed(_col("lists"), "text", "content"), F.lit("")), more)
    return _posting("lever", id=_col("id"), title=_col("text"), url=x.clean_url(_col("hostedUrl")), location=place, description=body, seen=_col("createdAt"), department=F.coalesce(_filled(_col("categories.department")), _col("categories.team")), flag=(F.lower(kind) == "remote") | _says_remote(place), words=kind, pay=F.coalesce(_col("salaryRange"), _col("salary")))


def _ashby() -> dict[str, Column]:
    place = x.clean_location(_col("location"))
    others = F.filter(F.transform(_col("secondaryLocations"), lambda s: x.clean_location(s["location"])), lambda s: s.isNotNull())
    kind = F.lower(_stripped(_col("workplaceType")))
    office = kind.isin("hybrid", "onsite", "on-site")
    parts = F.array_compact(F.concat(F.array(place), F.coalesce(others, F.array().cast("array<string>")), F.array(F.when(kind == "hybrid", "hybrid").when(office, "on-site"))))
    url = F.coalesce(_filled(_col("jobUrl")), F.concat(F.lit("https://jobs.ashbyhq.com/"), "slug", F.lit("/"), _col("id")))
    return _posting("ashby", id=_col("id"), title=_col("title"), url=x.clean_url(url), location=place, description=F.coalesce(_filled(_col("descriptionHtml")), _col("descriptionPlain")), seen=F.coalesce(_col("updatedAt"), _col("publishedAt")), scope=F.array_join(parts, "; "), department=_col("departmentName"), flag=(~office & F.coalesce(_col("isRemote"), F.lit(False))) | _says_remote(place), pay=F.coalesce(_col("compensationTier"), _col("compensation")))


def _workable() -> dict[str, Column]:
    place = x.clean_location(F.concat_ws(", ", *[_filled(_col(f"location.{k}")) for k in ("city", "region", "country")]))
    url = F.coalesce(_filled(_col("url")), F.concat(F.lit("https://apply.workable.com/"), "slug", F.lit("/j/"), _col("shortcode"), F.lit("/")))
    body = x.described((_col("description"), None), (_col("requirements"), "Requirements"), (_col("benefits"), "Benefits"))
    department = F.when(_col("department").startswith("["), F.get(F.from_json(_col("department"), "array<string>"), 0)).otherwise(_col("department"))
    return _posting("workable", id=_col("shortcode"), title=_col("title"), url=x.clean_url(url), location=place, description=body, seen=_col("published"), department=department, flag=F.coalesce(_col("remote"), F.lit(False)) | _says_remote(place), pay=_col("salary"))


def _smartrecruiters() -> dict[str, Column]:
    place = x.clean_location(F.concat_ws(" - ", *[_filled(_col(f"location.{k}")) for k in ("city", "region", "country")]))
    url = F.coalesce(_filled(_col("applyUrl")), F.concat(F.lit("https://jobs.smartrecruiters.com/"), "slug", F.lit("/"), _col("id")))
    sections = F.array(*[F.try_element_at(_col("jobAd.sections"), F.lit(k)) for k in ("companyDescription", "jobDescription", "qualifications", "additionalInformation")])
    return _posting("smartrecruiters", id=_col("id"), title=_col("name"), url=x.clean_url(url), location=place, description=_headed(sections, "title", "text"), seen=_col("releasedDate"), company=_col("company.name"), department=_col("department.label"), flag=F.coalesce(_col("location.remote"), F.lit(False)) | _says_remote(place))


def _recruitee() -> dict[str, Column]:
    own = F.array_distinct(F.array_compact(F.array(*[_filled(_col(k)) for k in ("location", "city", "country")])))
    place = F.array_join(own, ", ")
    other = F.coalesce(F.try_element_at(_col("translations"), F.lit("en")), F.get(F.map_values(_col("translations")), 0))
    body = x.described((F.coalesce(_filled(_col("description")), other["description"]), None), (F.coalesce(_filled(_col("requirements")), other["requirements"]), "Requirements"))
    far = F.coalesce(_col("remote"), F.lit(False))
    return _posting("recruitee", id=_col("id"), title=_col("title"), url=x.text_or_empty(_col("careers_url")), location=place, description=body, seen=_col("created_at"), scope=F.when(place != "", place).when(far, "Remote").otherwise(""), company=_col("company_name"), department=_col("department"), flag=far | _says_remote(place))


def _personio() -> dict[str, Column]:
    return _posting("personio", id=_col("id"), title=_col("name"), url=F.lit(""), location=_col("office"), description=_col("description"), seen=_col("createdAt"), department=_col("department"))


def _teamtailor() -> dict[str, Column]:
    """JSON:API: what relationships point at stands in `included`, looked up by type and id."""
    entries = F.transform(F.coalesce(_col("included"), F.array().cast(_INCLUDED)), lambda i: F.struct(F.concat(i["type"], F.lit("/"), i["id"]).alias("key"), i["attributes"].alias("value")))
    table = F.map_from_entries(entries)
    look = lambda kind, i: F.try_element_at(table, F.concat(F.lit(f"{kind}/"), i))
    town = lambda r: F.concat_ws(", ", look("locations", r["id"])["city"], look("locations", r["id"])["country"])
    place = F.array_join(F.filter(F.transform(_col("relationships.locations.data"), town), lambda t: t != ""), "; ")
    place = F.nullif(place, F.lit(""))
    a = lambda k: F.col(f"p.attributes.`{k}`")
    status = F.lower(x.text_or_empty(a("remote-status")))
    scope = F.concat_ws("; ", place, F.when(status == "full", "Remote").when(status == "hybrid", "hybrid"))
    pay = F.create_map(F.lit("min"), a("salary-min"), F.lit("max"), a("salary-max"), F.lit("currency"), a("salary-currency"), F.lit("period"), a("salary-time-unit"))
    pay = F.when(a("salary-min").isNotNull() | a("salary-max").isNotNull(), pay)
    return _posting("teamtailor", id=_col("id"), title=a("title"), url=x.clean_url(F.col("p.links.`careersite-job-url`")), location=place, description=a("body"), seen=a("created-at"), scope=scope, department=look("departments", _col("relationships.department.data.id"))["name"], flag=status == "full", words=a("body"), pay=pay)


def _traffit() -> dict[str, Column]:
    fields = F.map_from_entries(F.transform(F.filter(_col("advert.values"), lambda v: v["field_id"].isNotNull()), lambda v: F.struct(v["field_id"], F.coalesce(v["value"], F.lit("")))))
    field = lambda k: F.try_element_at(fields, F.lit(k))
    named = lambda b: F.nullif(F.concat_ws(", ", *[_filled(b[k]) for k in ("locality", "region1", "country")]), F.lit(""))
    town = lambda c: let(F.from_json(c, "locality string, region1 string, country string"), named)
    place = F.coalesce(town(_col("options.job_location")), town(field("geolocation")), F.lit(""))
    far = F.coalesce(_col("options.remote").isin("1", "true"), F.lit(False))
    body = x.described((field("description"), None), (field("requirements"), "Requirements"), (field("responsibilities"), "Responsibilities"), (field("what_we_offer"), "What we offer"))
    return _posting("traffit", id=_col("id"), title=_col("advert.name"), url=x.clean_url(_col("url")), location=place, description=body, seen=F.coalesce(_col("valid_start"), _col("_incremental_at")), scope=F.when(place != "", place).when(far, "Remote").otherwise(""), department=_filled(_col("options.branches")), flag=far, words=F.array_join(F.map_values(fields), " "))


def _jobadder() -> dict[str, Column]:
    place = x.clean_location(F.coalesce(_filled(_col("categories.location")), _col("locationText")))
    points = F.array_join(F.transform(F.filter(F.coalesce(_col("bulletPoints"), F.array().cast("array<string>")), lambda b: b != ""), lambda b: F.concat(F.lit("<li>"), b, F.lit("</li>"))), "")
    body = F.concat_ws("\n\n", F.when(points != "", F.concat(F.lit("<ul>"), points, F.lit("</ul>"))), F.nullif(x.described((_col("description"), None), (_col("summary"), "Summary")), F.lit("")))
    url = F.coalesce(_filled(_col("applicationUri")), F.concat(F.lit("https://jobadder.com/jobs/"), _col("adId")))
    named = F.from_json(_col("department"), "name string, label string")
    department = F.when(_col("department").startswith("{"), F.coalesce(named["name"], named["label"])).otherwise(_col("department"))
    pay = _col("salary")
    pay = F.map_concat(F.map_filter(pay, lambda k, _: k.isin("min", "max", "currency")), F.create_map(F.lit("period"), F.coalesce(F.try_element_at(pay, F.lit("per")), F.try_element_at(pay, F.lit("ratePer")))))
    return _posting("jobadder", id=_col("adId"), title=_col("title"), url=x.clean_url(url), location=place, description=body, seen=F.coalesce(_col("updatedAt"), _col("postedAt")), department=department, flag=F.lower(x.text_or_empty(_col("categories.locationType"))).isin("remote", "work from home"), pay=pay)


def _breezy() -> dict[str, Column]:
    place = _stripped(_col("location.name"))
    far = F.coalesce(_col("location.is_remote"), F.lit(False))
    url = F.coalesce(x.clean_url(_col("url")), F.concat(F.lit("https://"), "slug", F.lit(".breezy.hr/p/"), _col("_id")))
    pay = F.create_map(F.lit("min"), _col("salary_min"), F.lit("max"), _col("salary_max"), F.lit("currency"), _col("salary_currency"))
    published = F.when(F.lower(_col("state")) == "published", _col("_id"))
    return _posting("breezy", id=published, title=_col("name"), url=url, location=place, description=_col("description"), seen=_col("published_date"), scope=F.when(place != "", place).when(far, "Remote").otherwise(""), department=_filled(_col("department.name")), flag=far, words=F.array_join(_col("tags"), " "), pay=pay)


_INCLUDED = "array<struct<type:string,id:string,attributes:struct<name:string,city:string,country:string>>>"

#: Provider -> schema of one posting's payload, and its projection. The providers' field names.
PROVIDERS: dict[str, tuple[str, Callable[[], dict[str, Column]]]] = {
    "greenhouse": (f"id string, title string, absolute_url string, location struct<name:string>, updated_at string, pubDate string, company_name string, company string, content string, description string, departments array<struct<name:string>>, pay_bounds array<{PAY}>", _greenhouse),
    "lever": (f"id string, text string, hostedUrl string, categories struct<location:string,department:string,team:string>, workplaceType string, createdAt string, description string, descriptionPlain string, lists array<struct<text:string,content:string>>, additional string, additionalPlain string, salaryRange {PAY}, salary {PAY}", _lever),
    "ashby": (f"id string, title string, jobUrl string, location string, secondaryLocations array<struct<location:string>>, updatedAt string, publishedAt string, descriptionHtml string, descriptionPlain string, workplaceType string, isRemote boolean, departmentName string, compensationTier {PAY}, compensation {PAY}", _ashby),
    "workable": (f"shortcode string, title string, url string, location struct<city:string,region:string,country:string>, published string, description string, requirements string, benefits string, remote boolean, department string, salary {PAY}", _workable),
    "smartrecruiters": ("id string, name string, applyUrl string, location struct<city:string,region:string,country:string,remote:boolean>, releasedDate string, company struct<name:string>, department struct<label:string>, jobAd struct<sections:map<string,struct<title:string,text:string>>>", _smartrecruiters),
    "recruitee": ("id string, title string, location string, city string, country string, careers_url string, department string, remote boolean, description string, requirements string, company_name string, created_at string, translations map<string,struct<description:string,requirements:string>>", _recruitee),
    "personio": ("id string, name string, description string, office string, department string, createdAt string", _personio),
    "teamtailor": (f"id string, attributes struct<title:string,body:string,`remote-status`:string,`salary-min`:string,`salary-max`:string,`salary-currency`:string,`salary-time-unit`:string,`created-at`:string>, links struct<`careersite-job-url`:string>, relationships struct<department:struct<data:struct<id:string>>,locations:struct<data:array<struct<id:string>>>>, included {_INCLUDED}", _teamtailor),
    "traffit": ("id string, url string, valid_start string, _incremental_at string, advert struct<name:string,values:array<struct<field_id:string,value:string>>>, options struct<job_location:string,remote:string,branches:string>", _traffit),
    "jobadder": (f"adId string, title string, applicationUri string, categories struct<location:string,locationType:string>, locationText string, updatedAt string, postedAt string, description string, summary string, bulletPoints array<string>, department string, salary {PAY}", _jobadder),
    "breezy": ("_id string, name string, url string, state string, location struct<name:string,is_remote:boolean>, tags array<string>, description string, department struct<name:string>, published_date string, salary_min string, salary_max string, salary_currency string", _breezy),
}


def normalise(raw: DataFrame, provider: str, received_at: str) -> DataFrame:
    """Canonical postings of a provider's payloads, which they keep: raw has (slug, payload). Postings without an
    id or title, or (where the provider has addresses) without one, go; one without a time gets received_at."""
    schema, projection = PROVIDERS[provider]
    # Out of an array of one the payload is read once: what is asked of `p` below isn't put in terms of the payload.
    parsed = raw.select("slug", "payload", F.explode(F.array(F.from_json("payload", schema))).alias("p"))
    out = parsed.select(*[c.alias(n) for n, c in projection().items()], "payload")
    addressed = F.lit(True) if provider in ("personio", "recruitee") else F.coalesce(F.col("source_url"), F.lit("")) != ""
    kept = out.filter(F.col("source_job_id").isNotNull() & (F.col("title") != "") & addressed)
    return kept.withColumn("first_seen_at", F.coalesce("first_seen_at", now(received_at).cast("timestamp")))


def updated_since(postings: DataFrame, since: str | None, *keys: str) -> DataFrame:
    """Raw postings changed at or after a moment by the first of the columns `keys` that can be read as a
    time; those without a readable time always pass."""
    if since is None:
        return postings
    at = F.coalesce(*[x.moment(F.col(k).cast("string")) for k in keys])
    return postings.filter(at.isNull() | (at >= F.to_utc_timestamp(now(since).cast("timestamp"), "UTC")))


def with_details(summaries: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Summaries with their detail payloads where there are any (one detail per key)."""
    found = details.select(F.col(key).alias("__key"), F.col("payload").alias("__detail"))
    return summaries.join(found, F.col(key) == F.col("__key"), "left").withColumn("payload", F.coalesce("__detail", "payload")).drop("__key", "__detail")


def read_positions(spark: SparkSession, path: str, slug: str) -> DataFrame:
    """(slug, payload) of an XML feed's positions, their descriptions under their headings."""
    schema = "id string, name string, office string, department string, createdAt string, jobDescriptions struct<jobDescription:array<struct<name:string,value:string>>>"
    rows = spark.read.format("xml").option("rowTag", "position").schema(schema).load(path)
    parts = F.transform(F.col("jobDescriptions.jobDescription"), lambda d: F.struct(F.trim(d["name"]).alias("name"), F.trim(d["value"]).alias("value")))
    body = rows.withColumn("description", _headed(parts, "name", "value"))
    return body.select(F.lit(slug).alias("slug"), F.to_json(F.struct("id", "name", "description", "office", "department", "createdAt")).alias("payload"))


def probe(postings: DataFrame) -> DataFrame:
    """What a board holds: postings, remote ones, its latest time."""
    return postings.agg(F.count(F.lit(1)).alias("jobs_total"), F.count_if("remote_source_flag").alias("remote_hits"), F.max("first_seen_at").alias("recent_at"))

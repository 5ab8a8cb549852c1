"""Rules as SQL functions of a session, so that queries written in SQL can use them.

Each is a SQL function with an expression for its body, which Spark puts in place of the call; no Python
runs. Phrase lists and rates are those of the column expressions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from vacantia.functions import classify
from vacantia.functions.text import quote
from vacantia.sources.discovery import GUESSES, SUFFIXES


def _any(column: str, phrases) -> str:
    return f"{column} RLIKE r'{'|'.join(map(quote, phrases))}'"


def _word(column: str, phrases) -> str:
    return rf"{column} RLIKE r'\b(?:{'|'.join(map(quote, phrases))})\b'"


def _rule(column: str, rules) -> str:
    """The result of the first rule of which some word stands in the text."""
    return "CASE " + " ".join(f"WHEN {_word(column, words)} THEN '{result}'" for words, result in rules) + " ELSE 'unknown' END"


def _plain_title() -> str:
    sql = "lower(coalesce(title, ''))"
    for source, target in classify.SYNONYMS:
        sql = rf"regexp_replace({sql}, r'\b{quote(source)}\b', '{target}')"
    return sql


#: SQL of white space stripped at both ends.
_STRIPPED = r"regexp_replace(coalesce(value, ''), r'(?U)^\s+|\s+$', '')"

#: Name, parameters, type and body; later ones use earlier ones.
FUNCTIONS = (
    ("stripped_text", "value STRING", "STRING", _STRIPPED),
    ("normalised_text", "value STRING", "STRING", r"stripped_text(regexp_replace(lower(coalesce(value, '')), r'(?U)\s+', ' '))"),
    ("job_uid", "company_id STRING, title STRING, location STRING", "STRING", "sha2(concat_ws('|', coalesce(company_id, ''), normalised_text(title), normalised_text(location)), 256)"),
    ("job_fingerprint", "company_id STRING, company STRING, title STRING, location STRING, description STRING", "STRING",
     "md5(concat_ws('|', normalised_text(company_id), normalised_text(company), normalised_text(title), normalised_text(location), left(normalised_text(left(stripped_text(description), 1500)), 500)))"),
    ("canonical_job_id", "company STRING, title STRING, description STRING", "STRING", "sha1(concat_ws('|', normalised_text(company), normalised_text(title), left(normalised_text(left(stripped_text(description), 3000)), 1000)))"),
    ("is_hard_geo", "value STRING", "BOOLEAN", rf"lower(coalesce(value, '')) RLIKE r'\b(?:{'|'.join(classify.HARD)})\b'"),
    ("compliance_score", "remote_class STRING, geo_class STRING", "INT",
     f"CASE WHEN lower(remote_class) = 'non_remote' OR lower(geo_class) = 'non_eu' THEN 0 WHEN lower(geo_class) IN {classify.ELIGIBLE} THEN CASE coalesce(lower(remote_class), 'unknown') "
     + " ".join(f"WHEN '{kind}' THEN {score}" for kind, (score, _) in classify.MATRIX.items()) + " ELSE 20 END ELSE 20 END"),
    ("compliance_status", "remote_class STRING, geo_class STRING", "STRING",
     f"CASE WHEN lower(remote_class) = 'non_remote' OR lower(geo_class) = 'non_eu' THEN 'rejected' WHEN lower(geo_class) IN {classify.ELIGIBLE} THEN CASE coalesce(lower(remote_class), 'unknown') "
     + " ".join(f"WHEN '{kind}' THEN '{status}'" for kind, (_, status) in classify.MATRIX.items()) + " ELSE 'rejected' END ELSE 'rejected' END"),
    ("text_currency", "value STRING", "STRING", "CASE " + " ".join(f"WHEN contains(lower(value), '{mark}') THEN '{code}'" for mark, code in classify.CURRENCY_MARKS.items()) + " END"),
    ("in_euros", "amount DOUBLE, code STRING", "DOUBLE", "nullif(amount, 0) * CASE upper(code) " + " ".join(f"WHEN '{code}' THEN {rate}D" for code, rate in classify.EUROS.items()) + " END"),
    ("salary_transparency", "description STRING, detected BOOLEAN", "STRING",
     f"CASE WHEN detected THEN 'disclosed' WHEN coalesce(description, '') = '' THEN 'unknown' WHEN {_any('lower(description)', classify.TRANSPARENCY)} THEN 'transparent_statement' ELSE 'not_disclosed' END"),
    ("family_of_words", "value STRING", "STRING", _rule("lower(coalesce(value, ''))", classify.FAMILIES)),
    ("job_family", "title STRING, department STRING", "STRING", "coalesce(nullif(family_of_words(department), 'unknown'), family_of_words(title))"),
    ("job_role", "title STRING, department STRING", "STRING", "CASE job_family(title, department) " + " ".join(f"WHEN '{name}' THEN {_rule('lower(title)', rules)}" for name, rules in classify.ROLES.items()) + " ELSE 'unknown' END"),
    ("job_seniority", "title STRING", "STRING", _rule("lower(coalesce(title, ''))", classify.SENIORITIES)),
    ("job_specialization", "title STRING", "STRING", _rule(_plain_title(), classify.SPECIALIZATIONS)),
)
_CLEAN = r"regexp_replace(regexp_replace(lower(coalesce(name, '')), r'\b(inc|llc|ltd|gmbh|corp|co|limited|group)\b\.?', ''), r'(?U)^\s+|\s+$', '')"
#: Table functions: name, parameters, columns and the query that a call stands for.
TABLES = (
    ("slug_guesses", "name STRING", "place INT, slug STRING", rf"""
SELECT posexplode(slice(array_distinct(concat(bases, flatten(transform(array({', '.join(f"'{x}'" for x in SUFFIXES)}), s -> flatten(transform(bases, b -> array(concat(b, s), concat(b, '-', s)))))))), 1, {GUESSES}))
FROM (SELECT filter(array_distinct(array(regexp_replace(regexp_replace(regexp_replace(clean, r'[^a-z0-9\s_]+', ''), r'[\s_]+', '-'), r'^-+|-+$', ''), regexp_replace(clean, r'[^a-z0-9]+', ''))), b -> b <> '') AS bases
  FROM (SELECT coalesce(nullif({_CLEAN}, ''), lower(coalesce(name, ''))) AS clean))"""),
)


def register(spark: SparkSession) -> SparkSession:
    """The session with the FUNCTIONS and TABLES, which replace functions of its own that have their names."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, parameters, columns, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
    return spark

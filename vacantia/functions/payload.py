"""Landed payloads of any shape as variants: salaries from whichever field holds them, shapes, and byte repair.

All of it is column expressions. A payload is parsed once (`variant`), and one that is no JSON, or names a
key twice, is NULL and finds nothing.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions.classify import in_euros

# Fields that may hold a salary, and keys of its parts, in the order in which they are tried.
SALARY_FIELDS = ("salary", "salary_range", "compensation", "compensation_range", "base_salary", "pay_range", "pay", "pay_input_ranges", "salaryRange")
LOW, HIGH = ("min", "min_amount", "minimum"), ("max", "max_amount", "maximum")
CODE, PERIOD = ("currency", "currency_code", "currencyCode"), ("interval", "period", "unit")
PERIODS, USUAL = ("hour", "day", "month", "year"), "year"

#: A number as text, blanks around it and underscores between digits included.
_NUMBER = r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf(?:inity)?|nan)\s*$"


def variant(payload: Column) -> Column:
    return F.try_parse_json(payload)


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _holds(json: Column) -> Column:
    """Whether a value's JSON is more than nothing: no null, false, zero, or empty text, list or object."""
    zero = F.when(json.rlike(r"^-?\d"), json.try_cast("double") == 0)
    return json.isNotNull() & ~json.isin("null", "false", '""', "[]", "{}") & ~F.coalesce(zero, F.lit(False))


def _first(value: Column, keys: tuple[str, ...]) -> Column:
    """Of the keys' values the first that holds something, as JSON; if none does, the last one."""
    found = F.array(*[F.to_json(_at(value, f"$.{k}")) for k in keys])
    pick = lambda js: F.coalesce(F.get(F.filter(js, _holds), 0), F.get(js, len(keys) - 1))
    return F.get(F.transform(F.array(found), pick), 0)


def _text(json: Column) -> Column:
    """A scalar's JSON as text; NULL for null."""
    return F.when(json.startswith('"'), F.try_variant_get(F.try_parse_json(json), "$", "string")).when(json != "null", json)


def _number(json: Column) -> Column:
    """A number, a text that reads as one, or a truth value, as a double; NULL for anything else."""
    plain = F.regexp_replace(F.regexp_replace(_text(json), r"(?<=\d)_(?=\d)", ""), r"(?U)^\s+|\s+$", "")
    return F.when(json == "true", 1.0).when(json == "false", 0.0).when(~json.rlike(r"^[\[{]") & plain.rlike(_NUMBER), plain.try_cast("double"))


def structured_salary(value: Column) -> Column:
    """struct(salary_min, salary_max, salary_currency, salary_period, salary_source, salary_min_eur, salary_max_eur)
    of a payload's first field that holds a salary, NULL without one. A list counts by its first entry; a field
    counts for nothing unless it is an object with a bound, and each bound that is there reads as a number.
    Each step is a transformation of the fields' array, so that no expression is worked out twice."""
    json = F.transform(F.array(*[_at(value, f"$.{f}") for f in SALARY_FIELDS]), lambda v: F.struct(v.alias("v"), F.substring(F.to_json(v), 1, 1).alias("kind")))
    firsts = F.transform(json, lambda e: F.when(e["kind"] == "[", _at(e["v"], "$[0]")).otherwise(e["v"]))
    objects = F.filter(firsts, lambda v: F.substring(F.to_json(v), 1, 1) == "{")
    read = F.transform(objects, lambda v: F.struct(_first(v, LOW).alias("low"), _first(v, HIGH).alias("high"), _first(v, CODE).alias("code"), _first(v, PERIOD).alias("period")))
    given = F.filter(read, lambda r: _holds(r["low"]) | _holds(r["high"]))
    numbers = F.transform(given, lambda r: F.struct(r.alias("r"), _number(r["low"]).alias("low"), _number(r["high"]).alias("high"), F.lower(_text(r["period"])).alias("period")))
    fine = lambda j, n: F.coalesce(j == "null", F.lit(True)) | n.isNotNull()
    usable = F.filter(numbers, lambda r: fine(r["r"]["low"], r["low"]) & fine(r["r"]["high"], r["high"]) & ~F.coalesce((r["low"] == 0) & (r["high"] == 0), F.lit(False)))
    code = lambda j: F.when(j.startswith('"'), F.upper(_text(j))).otherwise(_text(j))
    named = F.transform(F.slice(usable, 1, 1), lambda r: F.struct(r["low"].alias("low"), r["high"].alias("high"), code(r["r"]["code"]).alias("code"), F.when(r["period"].isin(*PERIODS), r["period"]).otherwise(USUAL).alias("period")))
    whole = lambda r: F.struct(r["low"].alias("salary_min"), r["high"].alias("salary_max"), r["code"].alias("salary_currency"), r["period"].alias("salary_period"), F.lit("structured").alias("salary_source"), in_euros(r["low"], r["code"]).alias("salary_min_eur"), in_euros(r["high"], r["code"]).alias("salary_max_eur"))
    return F.get(F.transform(named, whole), 0)


_TOKEN = r'"(?:[^"\\]|\\.)*"(?:\s*:)?|[\[\]{}]|[^\s,:\[\]{}"]+'


def shape(payload: Column) -> Column:
    """The shape of a payload as text: an object's keys in order, kinds of scalars, the set of kinds in a list.

    The payload's tokens are folded over a stack; a closing bracket folds what stands above its opening
    one, so any depth is one expression. An entry of the stack has the key it belongs to, if any.
    """
    entry = lambda key, text: F.struct(key.cast("string").alias("k"), text.cast("string").alias("s"))
    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast("array<struct<k:string,s:string>>").alias("stack"), F.array().cast("array<int>").alias("opened"), F.array().cast("array<string>").alias("keys"), none.alias("key"))
    below = lambda a, n: F.slice(a, F.lit(1), n)

    def pushed(a: Column, key: Column, text: Column, opened: Column, keys: Column, stack: Column) -> Column:
        # Lists are sets: what a list holds already is not held twice, which keeps long ones short.
        base = F.coalesce(F.try_element_at(opened, F.lit(-1)), F.lit(0))
        item = entry(key, text)
        known = key.isNull() & F.array_contains(F.slice(stack, base + 1, F.greatest(F.size(stack) - base, F.lit(0))), item)
        return F.struct(F.when(known, stack).otherwise(F.concat(stack, F.array(item))).alias("stack"), opened.alias("opened"), keys.alias("keys"), none.alias("key"))

    def step(a: Column, token: Column) -> Column:
        stack, opened, keys, key = a["stack"], a["opened"], a["keys"], a["key"]
        base = F.coalesce(F.try_element_at(opened, F.lit(-1)), F.lit(0))
        items = F.slice(stack, base + 1, F.greatest(F.size(stack) - base, F.lit(0)))
        outer, before = below(opened, F.greatest(F.size(opened) - 1, F.lit(0))), below(stack, base)
        up, owner = below(keys, F.greatest(F.size(keys) - 1, F.lit(0))), F.try_element_at(keys, F.lit(-1))
        members = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(items), lambda i: F.concat(i["k"], F.lit(":"), i["s"])), ","), F.lit("}"))
        kinds = F.concat(F.lit("list["), F.array_join(F.array_sort(F.transform(items, lambda i: i["s"])), ","), F.lit("]"))
        scalar = F.when(token.startswith('"'), "str").when(token.isin("true", "false"), "bool").when(token == "null", "null").when(token.rlike(r"^-?\d+$"), "int").otherwise("float")
        name = F.coalesce(F.try_variant_get(F.try_parse_json(F.regexp_replace(token, r"\s*:$", "")), "$", "string"), F.lit(""))
        return (
            F.when(token.isin("{", "["), F.struct(stack.alias("stack"), F.concat(opened, F.array(F.size(stack))).alias("opened"), F.concat(keys, F.array(key)).alias("keys"), none.alias("key")))
            .when(token == "}", pushed(a, owner, members, outer, up, before))
            .when(token == "]", pushed(a, owner, kinds, outer, up, before))
            .when(token.startswith('"') & token.endswith(":"), F.struct(stack.alias("stack"), opened.alias("opened"), keys.alias("keys"), name.alias("key")))
            .otherwise(pushed(a, key, scalar, opened, keys, stack))
        )

    folded = F.aggregate(F.regexp_extract_all(payload, F.lit(_TOKEN), 0), start, step, lambda a: F.try_element_at(a["stack"], F.lit(1))["s"])
    return F.when(F.try_parse_json(payload).isNotNull(), folded)


def schema_hash(payload: Column) -> Column:
    """SHA-256 of a payload's shape, by which schema drift is seen; NULL for what is no JSON."""
    return F.sha2(shape(payload).cast("binary"), 256)


#: Characters that bytes of another charset read as Latin-1 leave behind; texts without one are not touched. Fixed values.
BROKEN = "âÃÂð\x80\x82\x99\x9f"
#: Charsets of one byte that are weighed where the bytes are no UTF-8, in order of preference.
CHARSETS = ("cp1252", "cp1250", "cp1251")


@cache
def _table(charset: str) -> tuple[str, str]:
    """Latin-1's upper half, and what the same bytes mean in another charset (where they mean anything)."""
    pairs = [(chr(n), bytes([n]).decode(charset, "ignore")) for n in range(0x80, 0x100)]
    return "".join(a for a, b in pairs if b), "".join(b for _, b in pairs if b)


def _plausible(text: Column) -> Column:
    """How much a text looks like prose: letters beyond ASCII beside letters count for it, capitals in the
    middle of a word, signs within words and control characters against it."""
    found = lambda pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
    letters = found(r"(?<=\p{L})(?=[^\x00-\x7F])\p{Ll}|(?=[^\x00-\x7F])\p{Ll}(?=\p{Ll})|(?=[^\x00-\x7F])\p{Lu}(?=\p{L})")
    odd = found(r"(?<=\p{Ll})(?=[^\x00-\x7F])\p{Lu}|(?<=\p{L})(?=[^\x00-\x7F])[\p{S}\p{No}](?=\p{L})")
    mixed = found(r"(?<=[A-Za-z])[\p{IsCyrillic}]|[\p{IsCyrillic}](?=[A-Za-z])")
    return letters - 3 * odd - 3 * mixed - 5 * found(r"[\x{80}-\x{9F}]")


def repaired(text: Column) -> Column:
    """A text whose bytes were read as Latin-1, read as they were meant.

    Only texts of Latin-1 characters with a telltale one are looked at. Bytes that are UTF-8 are read as
    UTF-8. Otherwise, only control characters (which no text has) prove another charset: of those weighed,
    the one under which the text looks most like prose is taken, if it looks better than as it stands.
    """
    narrow = (F.translate(text, BROKEN, "") != text) & ~text.rlike(r"[^\x{00}-\x{FF}]")
    as_bytes = F.encode(F.when(narrow, text), "ISO-8859-1")
    as_utf8 = F.when(F.is_valid_utf8(as_bytes.cast("string")), as_bytes.cast("string"))
    control = narrow & text.rlike(r"[\x{80}-\x{9F}]")
    options = [F.struct(_plausible(text).alias("score"), F.lit(0).alias("rank"), text.alias("text"))]
    for rank, charset in enumerate(CHARSETS, 1):
        read = F.translate(text, *_table(charset))
        options.append(F.struct(_plausible(read).alias("score"), F.lit(-rank).alias("rank"), read.alias("text")))
    best = F.array_max(F.array(*options))["text"]
    return F.coalesce(as_utf8, F.when(control, best), text)

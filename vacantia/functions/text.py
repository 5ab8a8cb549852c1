"""Text normalisation, identity hashes, URLs, dates and small text rules, as column expressions."""

from __future__ import annotations

from html import unescape
from html.entities import html5
from json import dumps

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions.columns import let

#: White space in the Unicode sense, which Java's \s alone is not.
SPACE = r"(?U)\s+"
#: Query parameters that only track. Fixed values.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid")
#: Remote scopes with a canonical name. Fixed values.
SCOPES = {
    "remote - europe": "europe",
    "remote europe": "europe",
    "eu remote": "europe",
    "remote eu": "europe",
    "remote (eu)": "europe",
    "remote worldwide": "worldwide",
}
#: Phrases that mark a remote job when a posting is read, and when a board is probed. Fixed values.
REMOTE_WORDS = ("remote job", "home based", "work from home", "fully remote")
PROBE_WORDS = ("remote", "anywhere", "distributed", "work from home")


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def strip(column: Column) -> Column:
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def normalise(column: Column) -> Column:
    """Lower case, white space collapsed and stripped; NULL is empty."""
    return strip(F.regexp_replace(F.lower(text_or_empty(column)), SPACE, " "))


def normalise_late(column: Column) -> Column:
    """The older order: lower case and stripped first, then collapsed."""
    return F.regexp_replace(strip(F.lower(text_or_empty(column))), SPACE, " ")


def stored_fingerprint(company_id: Column, company: Column, title: Column, scope: Column, description: Column) -> Column:
    """The fingerprint as the database backfilled it: nothing stripped, the text normalised before it is cut."""
    plain = lambda c: F.lower(F.regexp_replace(text_or_empty(c), r"\s+", " "))
    return F.md5(F.concat_ws("|", text_or_empty(company_id), plain(company), plain(title), plain(scope), F.left(plain(description), F.lit(500))).cast("binary"))


def without_tags(column: Column) -> Column:
    """Markup out of a JSON text, at any depth."""
    return F.regexp_replace(column, "<[^>]+>", "")


def collapse(column: Column) -> Column:
    return strip(F.regexp_replace(column, SPACE, " "))


def job_uid(company_id: Column, title: Column, location: Column) -> Column:
    """SHA-256 of company id (as it is), title and location."""
    return F.sha2(F.concat_ws("|", text_or_empty(company_id), normalise(title), normalise(location)).cast("binary"), 256)


def job_fingerprint(company_id: Column, company: Column, title: Column, location: Column, description: Column) -> Column:
    """MD5 of identity and the first 500 normalised characters; the text is cut before it is normalised."""
    start = F.substring(normalise(F.substring(strip(text_or_empty(description)), 1, 1500)), 1, 500)
    return F.md5(F.concat_ws("|", normalise(company_id), normalise(company), normalise(title), normalise(location), start).cast("binary"))


def canonical_job_id(company: Column, title: Column, description: Column) -> Column:
    start = F.substring(normalise(F.substring(strip(text_or_empty(description)), 1, 3000)), 1, 1000)
    return F.sha1(F.concat_ws("|", normalise(company), normalise(title), start).cast("binary"))


def whitespace(column: Column) -> Column:
    """One kind of line end and blank, no trailing blanks, no more than one empty line."""
    for pattern, put in ((r"\r\n?", "\n"), (" ", " "), (r"[ \t]+\n", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        column = F.regexp_replace(column, pattern, put)
    return strip(column)


def canonical_scope(column: Column) -> Column:
    key = strip(F.lower(text_or_empty(column)))
    table = F.create_map(*[F.lit(x) for pair in SCOPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), key)


def clean_url(column: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters. A value without scheme and
    host stays as it is; an empty one is NULL."""
    shape = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    name = lambda p: F.lower(F.split(p, "=", 2)[0])

    def cleaned(url: Column) -> Column:
        part = lambda i: F.regexp_extract(url, shape, i)
        kept = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(*TRACKING))
        out = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), part(3), let(F.array_join(kept, "&"), lambda query: F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))
        return F.when(url.rlike(shape), out).otherwise(url)

    return let(F.nullif(strip(column), F.lit("")), cleaned)


def clean_location(column: Column) -> Column:
    return F.nullif(collapse(column), F.lit(""))


def title_from_slug(column: Column) -> Column:
    return F.initcap(F.regexp_replace(column, "[-_]", " "))


def any_word(text: Column, phrases, flags: str = "(?i)") -> Column:
    """Some phrase stands in the text between word bounds."""
    return text.rlike(flags + r"\b(?:" + one_of(phrases) + r")\b")


def any_part(text: Column, phrases) -> Column:
    """Some phrase stands anywhere in the text."""
    return text.rlike(one_of(phrases))


def quote(phrase: str) -> str:
    return "".join(f"\\{c}" if c in r"\.^$|?*+()[]{}-#&~" else c for c in phrase)


def one_of(phrases, literal: bool = True) -> str:
    """A pattern's alternatives, those of one first character together and otherwise in order, so that a place
    where none begins is passed over quickly. Where they are patterns, not literal, their first character stands for itself."""
    put, rests = quote if literal else str, {}
    for phrase in phrases:
        rests.setdefault(phrase[0], []).append(put(phrase[1:]))
    return "|".join(put(first) + (rest[0] if len(rest) == 1 else "(?:" + "|".join(rest) + ")") for first, rest in rests.items())


def detects_remote(title: Column, location: Column, flag: Column | None = None, extra: Column | None = None, probe: bool = False) -> Column:
    """A flag says so, or the posting's words do."""
    words = F.concat_ws(" ", text_or_empty(title), text_or_empty(location), F.lit("") if extra is None else text_or_empty(extra))
    found = any_word(words, PROBE_WORDS if probe else REMOTE_WORDS)
    return found if flag is None else F.coalesce(flag, F.lit(False)) | found


def described(*parts: tuple[Column, str | None]) -> Column:
    """Non-blank parts under their headings, with an empty line between."""
    own = []
    for column, heading in parts:
        value = F.nullif(strip(column), F.lit(""))
        own.append(value if heading is None else F.concat(F.lit(f"<h3>{heading}</h3>\n"), value))
    return F.concat_ws("\n\n", *own)


def moment(column: Column) -> Column:
    """A source's time as a UTC timestamp: ISO 8601, RFC 2822, or seconds or milliseconds since 1970."""
    value = F.nullif(strip(column.cast("string")), F.lit(""))
    number = F.when(value.rlike(r"^-?\d+(\.\d+)?$"), value.try_cast("double"))
    seconds = F.when(number > 1e10, number / 1000).otherwise(number)
    rfc = F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(F.timestamp_micros((seconds * 1_000_000).cast("long")), F.when(value.rlike(r"^\d{4}-"), F.try_to_timestamp(value)), rfc)


#: Rewrites from HTML to Markdown, in this order; the order is part of the result. Fixed values.
HTML_STEPS = (
    (r"(?is)<(script|style)[^>]*>.*?</\1>", ""),
    (r"""(?is)<div[^>]*class=["'][^"']*content-conclusion[^"']*["'][^>]*>.*""", ""),
    (r"""(?is)<div[^>]*class=["'][^"']*content-intro[^"']*["'][^>]*>.*?</div\s*>""", ""),
    (r"(?iU)<(p|div|span)[^>]*>(?:&nbsp;| |<br\s*/?>|\s)*</\1>", ""),
    (r"(?iU)<(p|div|span)[^>]*>(?:&nbsp;| |<br\s*/?>|\s)*</\1>", ""),
    (r"(?i)</p\s*>", "\n\n"),
    (r"(?i)<p[^>]*>", ""),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)<hr[^>]*>", "\n---\n"),
    *((rf"(?i)<h{n}[^>]*>", "\n" + "#" * n + " ") for n in range(1, 7)),
    (r"(?i)</h[1-6]\s*>", "\n\n"),
    (r"(?i)<blockquote[^>]*>", "\n> "),
    (r"(?i)</blockquote\s*>", "\n\n"),
    (r"(?i)<li[^>]*>", "\n- "),
    (r"(?i)</li\s*>", ""),
    (r"(?i)</(?:ul|ol)\s*>", "\n\n"),
    (r"(?i)<(?:b|strong)[^>]*>", "**"),
    (r"(?i)</(?:b|strong)\s*>", "**"),
    (r"(?i)<(?:i|em|u)[^>]*>", "_"),
    (r"(?i)</(?:i|em|u)\s*>", "_"),
    (r"(?is)<a[^>]*>(.*?)</a>", "$1"),
    (r"(?i)</div\s*>", "\n\n"),
    (r"<[^>]+>", ""),
)
#: Paragraphs of no use to a reader. Fixed values.
BOILERPLATE = (
    "is proud to be an equal opportunity employer|is an equal opportunity employer|is committed to working with the broadest talent pool|We hire for skills and potential",
    "Please review our Candidate Privacy Notice|For information about our privacy practices, please visit",
)
#: Names that are also read without their semicolon, and the longest there is.
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def _named(column: Column) -> Column:
    """What a piece that begins with & and a name stands for, with the piece's rest; NULL if it is no reference.

    All names of the standard count. One without its semicolon may also be the beginning of a longer word:
    the longest name that the piece begins with is taken.
    """
    table = F.from_json(F.lit(dumps(html5)), "map<string,string>")  # one literal once the plan is made
    name = F.regexp_extract(column, r"^&([^\t\n\f <&#;]{1,32};?)", 1)
    bare = F.regexp_extract(column, rf"^&({'|'.join(_BARE)})", 1)
    read = lambda n: F.concat(F.try_element_at(table, n), F.substring(column, F.length(n) + 2, F.length(column)))
    return F.when(name != "", F.coalesce(read(name), F.when(bare != "", read(bare))))


def _numbered(column: Column) -> Column:
    """The same of a piece that begins with & and the number of a character."""
    number = F.regexp_extract(column, r"^&#([xX][0-9a-fA-F]+|[0-9]+);?", 1)
    digits = F.regexp_replace(number, r"^[xX]?0*(?=.)", "")
    code = F.when(F.length(digits) > 8, F.lit(0x7FFFFFFF)).when(number.rlike("^[xX]"), F.conv(digits, 16, 10).try_cast("long")).otherwise(digits.try_cast("long"))
    # Numbers of the standard that stand for another character, and those that stand for none.
    other = {n: unescape(f"&#{n};") for n in [0, 13, *range(0x80, 0xA0)]}
    table = F.create_map(*[x for n, c in other.items() for x in (F.lit(n).cast("long"), F.lit(c))])
    none = code.between(1, 8) | code.between(0xE, 0x1F) | (code == 0xB) | (code == 0x7F) | code.between(0xFDD0, 0xFDEF) | (F.lit(0xFFFE) == code.bitwiseAND(0xFFFE))
    # A code point as text, by way of its UTF-32 bytes.
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    value = F.coalesce(F.try_element_at(table, code), F.when((code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd").when(none, "").otherwise(char))
    return F.when(number != "", F.concat(value, F.regexp_replace(column, r"^&#(?:[xX][0-9a-fA-F]+|[0-9]+);?", "")))


def unescaped(column: Column) -> Column:
    """Character references decoded once, as the standard has them: no second reading of what a decoded & makes."""
    one = lambda p: F.when(p.startswith("&#"), F.coalesce(_numbered(p), p)).when(p.startswith("&"), F.coalesce(_named(p), p)).otherwise(p)
    whole = lambda c: F.when(c.contains("&"), F.array_join(F.transform(F.split(c, r"(?=&)"), one), "")).otherwise(c)
    return F.get(F.transform(F.array(column), whole), 0)  # the column is worked out once


def markdown(column: Column) -> Column:
    """HTML as Markdown text, without boilerplate paragraphs."""
    for pattern, put in HTML_STEPS:
        column = F.regexp_replace(column, pattern, put)
    column = F.regexp_replace(unescaped(column), r"<[^>]+>", "")
    for phrases in BOILERPLATE:
        column = F.regexp_replace(column, rf"(?i)(?:\n\n|^)[^\n]*(?:{phrases})[\s\S]*?(?=\n\s*\n|$(?!\n))", "")
    return strip(F.regexp_replace(column, r"\n{3,}", "\n\n"))


def without_artifacts(column: Column) -> Column:
    """Malformed links, empty emphasis and lines of nothing but markers go; rules (--- and ***) stay."""
    for pattern, put in (
        (r"\[([0-9\.]+)\]\(https?://[0-9\.]+\)", "$1"),
        (r"\*+\s*\*+", " "),
        (r"_+\s*_+", " "),
        (r"(?m)^\s*(?!-{3,}$|\*{3,}$)([#*_-]+|>{1,})\s*$", ""),
        (r"(?m)^\s*(\*\*|__)\s*$", ""),
    ):
        column = F.regexp_replace(column, pattern, put)
    return column


def clean_description(column: Column, source: Column | None = None) -> Column:
    """A posting's description as it is stored; where its source is given, without that source's spam."""
    clean = without_artifacts(markdown(column))
    return whitespace(clean if source is None else without_spam(clean, source))


def leftover_tags(column: Column) -> Column:
    """Names of the tags that a text still holds."""
    return F.transform(F.regexp_extract_all(column, F.lit(r"</?([a-zA-Z][a-zA-Z0-9]*)[^>]*>"), 1), lambda t: F.lower(t))


#: Spam of one source. Fixed values.
SPAM = (
    r"(?i)please mention the word\s+[a-z0-9]+\s+(?:when applying|in your application)[^\n]*\n?",
    r"(?i)(?:this is a\s+)?beta feature to avoid spam[^\n]*\n?",
    r"(?i)rmtg[-a-z0-9+/]+={0,2}\s*\n?",
    r"""(?i)<img[^>]+src=["'][^"']*tracking[^"']*["'][^>]*>""",
)


def without_spam(column: Column, source: Column) -> Column:
    """One source's texts without its spam lines; other sources' as they are."""
    clean = column
    for pattern in SPAM:
        clean = F.regexp_replace(clean, pattern, "")
    return F.when(source == "remoteok", clean).otherwise(column)

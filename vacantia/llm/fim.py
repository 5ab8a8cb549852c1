"""Fill-in-middle: texts are cut at two ranks among their units and put together again behind marks.

A unit is a match of a pattern, left to right (any code point, unless another is given). Units are never
stored: a first pass over a text's matches counts them, a second one advances a lazy iterator to the first
rank and on to the second, so that beside the text and its output a task holds two positions.

A document's ranks and form follow from a hash of its id, so reruns and copies of a table agree:

* plain: the text itself. Empty texts, texts that hold a mark, and a share of all others;
* psm: prefix, suffix, middle behind their marks; spm: suffix, prefix, middle.

Nulls: a null text counts as empty; a null id hashes as an empty one. Repeated rows (and ids) are
transformed alike, each by itself. What stands before the first unit, between units and behind the last
belongs to the unit before it (to the prefix, if there is none). An empty table gives an empty result.
Other columns pass through whatever their names are, as the ones that are added start with `__fim_`.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm import common

#: Marks of prefix, suffix and middle; shares in percent: of all that are transformed, and of those spm.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED, SPM = 90, 20
#: Any code point, line ends included.
CODE_POINT = r"(?s:.)"
SEED = "1"
#: Text of a shard.
SHARD_BYTES = 1 << 20

_ADDED = T.StructType([T.StructField("__fim_n", T.LongType()), T.StructField("__fim_form", T.StringType()), T.StructField("__fim_prefix", T.LongType()), T.StructField("__fim_middle", T.LongType()), T.StructField("__fim_output", T.StringType())])
_ARROW = [pa.field("__fim_n", pa.int64()), pa.field("__fim_form", pa.string()), pa.field("__fim_prefix", pa.int64()), pa.field("__fim_middle", pa.int64()), pa.field("__fim_output", pa.string())]


def draws(doc_id: int | None, seed: str = SEED) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 that follow from an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def n_units(unit: re.Pattern, text: str) -> int:
    """First pass: how many matches there are; only the number of the last one is kept."""
    last = deque(zip(count(1), unit.finditer(text)), maxlen=1)
    return last[0][0] if last else 0


def ends(unit: re.Pattern, text: str, first: int, second: int) -> tuple[int, int]:
    """Second pass: where the unit behind `first` units begins, and the one behind `second` units (not fewer)."""
    matches = unit.finditer(text)
    at = next(islice(matches, first, None), None)
    a = len(text) if at is None else at.start()
    if at is None or second == first:
        return a, a
    at = next(islice(matches, second - first - 1, None), None)
    return a, len(text) if at is None else at.start()


def transform_text(text: str, doc_id: int | None, unit: re.Pattern, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), transformed: int = TRANSFORMED, spm: int = SPM, seed: str = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix and the middle or None, output) of one text."""
    n = n_units(unit, text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in marks) or h3 % 100 >= transformed:
        return n, "plain", None, None, text
    a, b = ends(unit, text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    p, s, m = marks
    if h4 % 100 < spm:
        return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def _task(text: int, doc_id: int, pattern: str, options: dict):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = re.compile(pattern)
        for shard in common.shards(batches, text, SHARD_BYTES):
            rows = []
            for t, i in zip(shard.column(text).to_pylist(), shard.column(doc_id).to_pylist(), strict=True):
                rows.append(transform_text(t or "", i, unit, **options))
            for field, values in zip(_ARROW, zip(*rows, strict=True), strict=True):
                shard = shard.append_column(field, pa.array(values, field.type))
            yield from shard.to_batches()

    return task


def transform(docs: DataFrame, doc_id="doc_id", text="text", unit: str = CODE_POINT, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), transformed: int = TRANSFORMED, spm: int = SPM, seed: str = SEED) -> DataFrame:
    """docs with __fim_n (units), __fim_form, __fim_prefix and __fim_middle (code points; null if plain) and
    __fim_output. One pass over the rows, no shuffle. Marks must be such that none can begin within another,
    else an output could be read in two ways; a pattern must not match the empty string."""
    apart = lambda a, b: (a is b or b not in a) and not any(a[i:] == b[: len(a) - i] for i in range(1, len(a)))
    if not all(marks) or not all(apart(a, b) for a in marks for b in marks):
        raise ValueError(f"marks {marks} overlap")
    if re.compile(unit).match(""):
        raise ValueError(f"{unit} matches the empty string")
    common.bounded_batches(docs.sparkSession)
    options = {"marks": tuple(marks), "transformed": transformed, "spm": spm, "seed": seed}
    task = _task(docs.columns.index(text), docs.columns.index(doc_id), unit, options)
    return docs.mapInArrow(task, T.StructType(docs.schema.fields + _ADDED.fields))


def restored(form: str | Column = "__fim_form", output: str | Column = "__fim_output", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text again, from its output and form: each mark stands once in a transformed output, so it has four parts."""
    form, output = (F.col(c) if isinstance(c, str) else c for c in (form, output))
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    text = lambda a, b, c: F.concat(*[F.get(parts, F.lit(k)) for k in (a, b, c)])
    return F.when(form == "psm", text(1, 3, 2)).when(form == "spm", text(2, 3, 1)).otherwise(output)


def op13(spark, sf_dir: str) -> DataFrame:
    """Every document transformed, by the contract of op13; the restored text is made from output and form alone."""
    out = transform(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", F.col("__fim_n").alias("n"), F.col("__fim_form").alias("form"), F.col("__fim_prefix").alias("prefix_chars"), F.col("__fim_middle").alias("middle_chars"),
        sha(F.col("__fim_output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

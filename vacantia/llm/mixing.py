"""Mixing sources to target weights by a time-varying curriculum (DataFrame functions only).

Each source has a target number of words and a weight schedule over training time t in [0, 1]. The
schedule's integral is the source's cumulative demand; a document that begins at word x of its
source's (repeated) stream is assigned the time at which demand reaches x, and the output is
range-sorted by that time.

Nulls: a null text has size 0, a null source is a source of its own (last in order), a null id orders
as an empty one. Documents without words take nothing. Repeated rows each take their own share. An
empty table gives an empty result. Other columns pass through untouched whatever their names are, as
working columns have names that start with `__mix_`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantia.llm import common

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Demand at t = 0 relative to its mean, for each of the weights; at t = 1 it is 2 minus that.
OPENING = (0.5, 1.0, 1.5)
#: No source, and no document, is taken more often than this.
REPEATS = 3
#: Rows of one source that are numbered by one task, about.
BUCKET_ROWS = 2_000

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _cycle(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, opening=OPENING, repeats: int = REPEATS) -> DataFrame:
    """(__mix_key, __mix_total) per source -> with targets.

    Targets are min(repeats * size, level * weight), where `level` makes them add up to all words:
    resharing what is above a cap by weight until nothing is above ends there. Sorted by cap / weight,
    the level is the first one at which no later source is capped, so one running sum finds it.
    The table has one row per source, which bounds these windows.
    """
    s, w, cap = "__mix_total", "__mix_weight", F.col("__mix_total") * repeats
    ranked = sizes.withColumn("__mix_n", F.row_number().over(W.orderBy("__mix_key")) - 1)
    ranked = ranked.withColumns({w: _cycle(weights, F.col("__mix_n")), "__mix_open": _cycle(opening, F.col("__mix_n"))})
    order = W.orderBy(cap / F.col(w), "__mix_key")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0))
    level = (F.sum(s).over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))).cast("double") / F.sum(w).over(after)
    ranked = ranked.withColumn("__mix_level", level)
    fits = F.when(F.col("__mix_level") <= cap / F.col(w), F.col("__mix_level"))
    # The levels fall until the first that fits, and the ones after it are no lower: the least that fits is the first.
    ranked = ranked.withColumn("__mix_rank", F.row_number().over(order)).withColumn("__mix_fit", F.min(F.when(fits.isNotNull(), F.struct("__mix_rank", "__mix_level"))).over(everything))
    target = F.least(cap.cast("double"), F.col("__mix_fit.__mix_level") * F.col(w))
    return ranked.select("__mix_key", s, target.alias("__mix_target"), "__mix_open")


def when_reached(share: Column, opening: Column) -> Column:
    """The time at which a share of the demand is met, if demand falls or rises in a line from `opening` to 2 - opening."""
    bend = 1 - opening
    return F.when(opening == 1, share).otherwise((F.sqrt(opening * opening + 4 * bend * share) - opening) / (2 * bend))


def mix(docs: DataFrame, doc_id="doc_id", text="text", source="source", weights=WEIGHTS, opening=OPENING, repeats: int = REPEATS, n_rows: int | None = None, size: Column | None = None) -> DataFrame:
    """docs with what the mix takes of each row: __mix_size, __mix_total (of its source), __mix_target,
    __mix_start (first word in its source's stream), __mix_open and __mix_taken.

    A source's documents stand in the order of a hash of their ids. Their running word count is made
    in three steps so that a hot source is not one task: sums of coarse hash ranges, of ranges within these, then counts
    within a range.
    Sizes are counted in the text where no column of them is given; where one is, equal rows are one until
    their words are dealt out, so that neither is an id that very many rows share.
    """
    n_rows = docs.count() if n_rows is None else n_rows
    digits = max(1, math.ceil(math.log(max(n_rows / BUCKET_ROWS, 1), 16)))
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    sized = docs.withColumns({"__mix_key": F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source))), "__mix_size": n_words(text) if size is None else size, "__mix_order": key, "__mix_range": F.substring(key, 1, digits)})
    if size is None:
        sized = sized.withColumn("__mix_copies", F.lit(1))
    else:
        sized = sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("__mix_copies"))
    words = F.col("__mix_size") * F.col("__mix_copies")
    ranges = sized.groupBy("__mix_key", "__mix_range").agg(F.sum(words).alias("__mix_words"))
    # A source's ranges stand in coarse ones, about as many as each of those has, so no task has all of them.
    ranges = ranges.withColumn("__mix_coarse", F.substring("__mix_range", 1, digits // 2))
    coarse = ranges.groupBy("__mix_key", "__mix_coarse").agg(F.sum("__mix_words").alias("__mix_sum"))
    earlier = W.partitionBy("__mix_key").orderBy("__mix_coarse").rowsBetween(W.unboundedPreceding, -1)
    coarse = coarse.withColumn("__mix_first", F.coalesce(F.sum("__mix_sum").over(earlier), F.lit(0)))
    nearer = W.partitionBy("__mix_key", "__mix_coarse").orderBy("__mix_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("__mix_near", F.coalesce(F.sum("__mix_words").over(nearer), F.lit(0)))
    targets = source_targets(coarse.groupBy("__mix_key").agg(F.sum("__mix_sum").alias("__mix_total")), weights, opening, repeats)
    ranges = ranges.join(coarse.drop("__mix_sum"), ["__mix_key", "__mix_coarse"]).withColumn("__mix_before", F.col("__mix_first") + F.col("__mix_near"))
    plan = ranges.select("__mix_key", "__mix_range", "__mix_before").join(targets, "__mix_key")
    # Rows of one id and size differ in their texts, if in anything: reruns deal them alike.
    ties = [F.xxhash64(text)] if size is None else []
    inside = W.partitionBy("__mix_key", "__mix_range").orderBy("__mix_order", F.col(doc_id), "__mix_size", *ties).rowsBetween(W.unboundedPreceding, -1)
    out = sized.join(plan, ["__mix_key", "__mix_range"]).withColumn("__mix_start", F.col("__mix_before") + F.coalesce(F.sum(words).over(inside), F.lit(0)))
    if size is not None:
        out = out.withColumn("__mix_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__mix_copies") - 1)))
        out = out.withColumn("__mix_start", F.col("__mix_start") + F.col("__mix_copy") * F.col("__mix_size")).drop("__mix_copy")
    passes = [_words(i) for i in range(repeats)]
    return out.withColumn("__mix_taken", sum(passes[1:], passes[0]))


def _words(i: int) -> Column:
    """Words that pass i over the source takes of a row."""
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("__mix_size"), F.floor("__mix_target") - i * F.col("__mix_total") - F.col("__mix_start")))


def position(i: int = 0) -> Column:
    """Training time of a row's pass i (null if the mix doesn't take it then)."""
    share = (F.col("__mix_start") + i * F.col("__mix_total")) / F.col("__mix_target")
    return F.when(_words(i) > 0, when_reached(share, F.col("__mix_open")))


def mixed_corpus(docs: DataFrame, repeats: int = REPEATS, **columns) -> DataFrame:
    """The rows that the mix takes, once for each pass, in order of training time, with docs' columns.

    The last document that a source's target reaches into is shortened to the words that are taken.
    Documents without words take nothing and go.
    """
    text = columns.get("text", "text")
    mixed = mix(docs, repeats=repeats, **columns)
    each = mixed.withColumn("__mix_pass", F.explode(F.array_compact(F.array(*[F.when(_words(i) > 0, F.struct(_words(i).alias("words"), position(i).alias("time"))) for i in range(repeats)]))))
    # Cut behind the n-th word without splitting the text anywhere else.
    pieces = F.split(F.col(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    start = F.array_join(F.slice(pieces, F.lit(1), F.col("__mix_pass.words").cast("int")), "")
    each = each.withColumn(text, F.when(F.col("__mix_pass.words") < F.col("__mix_size"), start).otherwise(F.col(text)))
    return each.orderBy("__mix_pass.time", "__mix_order").select(*docs.columns)


def op8(spark, sf_dir: str) -> DataFrame:
    """Words taken of every document, by the contract of op8, in order of training time. Words are counted in
    one pass over the texts; their counts are what the mix is made of."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", n_words("text").alias("text"), "source")
    out = mix(common.cut(docs, "document-sizes"), size=F.col("text"))
    return out.select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_total").alias("source_size"), F.col("__mix_target").alias("target"), F.col("__mix_taken").alias("taken"), F.round(position(), 6).alias("first_position")).orderBy("first_position", "doc_id")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE concat('0', source) END AS k,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
sources AS (SELECT k, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY encode(k)) - 1 AS n FROM sized GROUP BY k),
weighed AS (SELECT k, s, CASE n % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, CASE n % 3 WHEN 0 THEN 0.5e0 WHEN 1 THEN 1e0 ELSE 1.5e0 END AS o FROM sources),
levels AS (
  SELECT k, s, w, o, row_number() OVER (ORDER BY s * 3 / w, k) AS r,
         CAST(CAST(sum(s) OVER () AS BIGINT) - CAST(coalesce(sum(s * 3) OVER (ORDER BY s * 3 / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS DOUBLE)
           / CAST(sum(w) OVER (ORDER BY s * 3 / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM weighed),
fit AS (SELECT level AS x FROM levels WHERE level <= s * 3 / w ORDER BY r LIMIT 1),
targets AS (SELECT k, s, o, least(CAST(s * 3 AS DOUBLE), x * w) AS target FROM levels, fit),
placed AS (
  SELECT doc_id, size, s, o, target, CAST(coalesce(sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b
  FROM sized JOIN targets USING (k)),
taken AS (SELECT *, CAST(floor(target) AS BIGINT) AS t FROM placed),
passes AS (SELECT *, greatest(0, least(size, t - b)) AS w0, greatest(0, least(size, t - s - b)) AS w1, greatest(0, least(size, t - 2 * s - b)) AS w2 FROM taken)
SELECT doc_id, CAST(size AS BIGINT) AS size, s AS source_size, target, CAST(w0 + w1 + w2 AS BIGINT) AS taken,
       CASE WHEN w0 > 0 THEN round(CASE WHEN o = 1 THEN b / target ELSE (sqrt(o * o + 4 * (1 - o) * (b / target)) - o) / (2 * (1 - o)) END, 6) + 0e0 END AS first_position
FROM passes
"""

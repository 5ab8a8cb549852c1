"""An inverted table of trigrams, by which texts near a word are found without ranking all of them.

The table has a row for each trigram of each text: (gram, key, size), size being how many the text has. It is
kept sorted by gram, so a search reads the parts that hold the query's trigrams. How many of these a key
has gives its exact distance; a key with none is at distance 1 and needs no rank. Where only distances up
to a bound are asked for, sizes that are too different are passed over: texts of m and n trigrams are no
nearer than 1 - min(m, n) / max(m, n).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions.columns import trigrams
from vacantia.operators.search import bounded


def postings(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(gram, key, field, size) of the texts in some columns; a NULL text has none."""
    texts = rows.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns])).alias("t")).select("key", "t.*")
    held = texts.filter(F.col("text").isNotNull()).withColumn("grams", trigrams(F.col("text")))
    return held.select(F.explode("grams").alias("gram"), "key", "field", F.size("grams").alias("size"))


def write(rows: DataFrame, path: str, key: str, *columns: str) -> None:
    """The table of `postings` as files sorted by gram; a frequent gram goes to several."""
    table = postings(rows, key, *columns)
    table.repartitionByRange(F.col("gram"), F.xxhash64("key")).sortWithinPartitions("gram", "key").write.mode("overwrite").parquet(path)


def distances(index: DataFrame, q: str, most: float = 1.0) -> DataFrame:
    """(key, distance) of the keys that share a trigram with q in one of their fields, the nearest field's,
    where it is at most `most`. The query's trigrams, some of its letters' number, are constants of the plan."""
    own = index.sparkSession.range(1).select(trigrams(F.lit(q)).alias("g")).first().g
    held = index.filter(F.col("gram").isin(own))
    if most < 1:
        held = held.filter((F.col("size") >= (1 - most) * len(own)) & ((1 - most) * F.col("size") <= len(own)))
    shared = held.groupBy("key", "field").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    distance = 1 - F.col("n") / (F.col("size") + len(own) - F.col("n"))
    return shared.groupBy("key").agg(F.min(distance).alias("distance")).filter(F.col("distance") <= most)


def page(found: DataFrame, index: DataFrame, q: str, limit: int, offset: int = 0, key: str = "job_id", fields: tuple[str, ...] = ("title", "company_name")) -> DataFrame:
    """search.page by distance from q, with distances out of the index: those found that share a trigram with q are
    ranked among themselves, the others follow by their date, and of neither more than a page's end is kept."""
    limit, offset = bounded(limit, offset)
    order = [F.asc_nulls_last("__distance"), F.desc_nulls_first("first_seen_at"), F.asc(key)]
    near = distances(index, q).select(F.col("key").alias("__key"), F.col("distance").alias("__distance"))
    ranked = found.join(near, F.col(key) == F.col("__key")).drop("__key").orderBy(*order).limit(limit + offset)
    nowhere = F.lit(True)
    for c in fields:
        nowhere = nowhere & F.col(c).isNull()
    rest = found.join(near.select("__key"), F.col(key) == F.col("__key"), "left_anti").withColumn("__distance", F.when(~nowhere, F.lit(1.0)))
    rest = rest.orderBy(*order).limit(limit + offset)
    return ranked.unionByName(rest).orderBy(*order).offset(offset).limit(limit).drop("__distance")

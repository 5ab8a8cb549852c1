"""Exact top-k search: tiled matrix products, a partial selection per tile, a tree of merges.

Queries go out in blocks of bounded size, each of which meets every shard of the table; a larger query
set takes more blocks, not larger ones. In a task, a tile of candidates is multiplied with the block,
the best k per query are selected (not sorted) and merged with those of the task's earlier tiles.
Tasks' lists meet in groups, and groups' lists per query, so that no query's lists meet in one place
before they are few.

Vectors that are null, hold null or non-finite components, or are empty take no part; a query meets
only vectors of its own length. Equal scores are in the order of the ids. A vector is never its own
candidate: rows that share a query's id are skipped. Every other row is a candidate, so an id on several
rows may fill several places. A repeated query id has one list, the best of the pairs of each of its rows
with each candidate row. Rows without an id take no part. Scores beyond 62 bits are held at that bound.
Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantia.llm import common

#: Components of a block of queries; queries and candidates of a tile; groups of tasks that merge first.
BLOCK, QUERIES, TILE, GROUPS = 1 << 22, 512, 4096, 32
SCALE = 256

_NONE = -(1 << 62)
_HITS = "query_id bigint, vec_id bigint, score bigint, part int"


def quantised(vectors: DataFrame, vec_id="vec_id", vector="embedding", scale: int = SCALE) -> DataFrame:
    """(id, v): whole numbers floor(scale * x) of the vectors that take part."""
    x = F.col(vector)
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    return vectors.filter(F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, fine)).select(F.col(vec_id).cast("long").alias("id"), whole.alias("v"))


def products(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where no sum can leave its whole numbers."""
    limit = int(np.abs(queries).max(initial=0)) * int(np.abs(tile).max(initial=0)) * tile.shape[1]
    if limit < 1 << 53:
        kind = np.float32 if limit < 1 << 24 else np.float64
        return (queries.astype(kind) @ tile.T.astype(kind)).astype(np.int64)
    if limit < 1 << 62:
        return queries @ tile.T
    return np.clip(queries.astype(object) @ tile.T.astype(object), _NONE + 1, -_NONE).astype(np.int64)


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's scores the k largest in order, equal ones by id; _NONE fills up short rows."""
    n = scores.shape[1]
    best, names = np.full((len(scores), k), _NONE, np.int64), np.zeros((len(scores), k), np.int64)
    kth = min(k, n)
    bound = np.partition(scores, n - kth, axis=1)[:, n - kth]
    row, at = np.nonzero((scores >= bound[:, None]) & (scores > _NONE))
    found, who = scores[row, at], ids[row, at]
    order = np.lexsort((who, -found, row))
    row, found, who = row[order], found[order], who[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < k
    best[row[keep], rank[keep]], names[row[keep], rank[keep]] = found[keep], who[keep]
    return best, names


def _searcher(query_ids: np.ndarray, queries: np.ndarray, k: int):
    length = queries.shape[1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, names = np.full((len(queries), k), _NONE, np.int64), np.zeros((len(queries), k), np.int64)
        for batch in batches:
            vectors = batch.filter(pa.compute.equal(pa.compute.list_value_length(batch.column(1)), length))
            ids = vectors.column(0).to_numpy(zero_copy_only=False)
            flat = vectors.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
            for begin in range(0, len(ids), TILE):
                tile, own = flat[begin : begin + TILE], ids[begin : begin + TILE]
                for q in range(0, len(queries), QUERIES):
                    part = slice(q, q + QUERIES)
                    scores = products(queries[part], tile)
                    scores[query_ids[part][:, None] == own[None, :]] = _NONE
                    s, i = select(scores, np.broadcast_to(own, scores.shape), k)
                    best[part], names[part] = select(np.hstack([best[part], s]), np.hstack([names[part], i]), k)
        row, rank = np.nonzero(best > _NONE)
        task = np.full(len(row), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_pydict({"query_id": query_ids[row], "vec_id": names[row, rank], "score": best[row, rank], "part": task})

    return search


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries of one length at a time, BLOCK components together at most; the driver holds one per length."""
    waiting: dict[int, list] = {}
    for name, v in queries.toLocalIterator():
        own = waiting.setdefault(len(v), [])
        own.append((name, v))
        if len(own) * len(v) >= BLOCK:
            yield np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own], np.int64)
            del waiting[len(v)]
    for own in waiting.values():
        yield np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own], np.int64)


def search(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of `vectors`; both have columns (id, v)."""
    spark = vectors.sparkSession
    common.bounded_batches(spark)
    folder, every = None, _blocks(queries)
    waiting = next(every, None)
    while waiting is not None:
        following = next(every, None)
        if folder is None and following is not None:
            vectors = common.cut(vectors, "vectors")  # several blocks read the whole numbers, not what they are made of
        block = vectors.mapInArrow(_searcher(*waiting, k), _HITS)
        waiting = following
        folder = folder or common.shared_dir(spark, "top-lists")
        block.write.mode("append").parquet(folder)
    lists = spark.createDataFrame([], _HITS) if folder is None else spark.read.schema(_HITS).parquet(folder)
    order = [F.desc("score"), "vec_id"]
    group = F.col("part") % GROUPS
    lists = lists.withColumn("group", group).withColumn("rank", F.row_number().over(W.partitionBy("query_id", "group").orderBy(*order))).filter(F.col("rank") <= k)
    return lists.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4(spark, sf_dir: str) -> DataFrame:
    """The 5 best of every query vector, by the contract of op4."""
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return search(vectors.filter(F.col("id") % 50 == 0), vectors, 5)


ORACLE = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v))
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM pairs
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

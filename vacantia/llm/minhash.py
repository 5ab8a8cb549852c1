"""Document fingerprints by MinHash, near duplicates by bands of signatures.

A document is its set of distinct word shingles (those of the Jaccard join). Its signature holds, for each
of SIZE universal hash permutations x -> a * x + b of 64-bit numbers (a odd), the least value among its
shingles; two signatures agree at a place with the probability of the sets' Jaccard similarity. All of it
is numpy over blocks of shingles.

* The fingerprint is one byte of each of the first PLACES values. Different values share a byte one
  time in 256, which the likeness of two fingerprints takes off again.
* Near duplicates: rows of a signature are hashed to BANDS bands. Documents with one set are one member;
  members with a band in common are tied to the least of them, so a hot band gives as many ties as members;
  tied members form clusters, within which links are decided on whole sets (verified by Jaccard similarity).
  A pair of similarity 0.8 shares no band with a probability of 3 in a million, a less similar one is no link.
* Neighbours: documents stand in the order of their ids over range partitions that streams read, each row
  with the next one; the last row of a partition and the first of the next meet in a small join.

Nulls: a null text counts as empty. Texts without words have no shingles and an empty set's fingerprint
(all f), which is like itself only and near to nothing. Null ids come first in the order, equal ids are
ordered by a hash of their texts, and repeated rows (which are alike) follow one another. A table of one
row is its own next. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantia.llm import common, graph, jaccard

#: Words of a shingle, and least similarity in percent of near duplicates.
WORDS, PERCENT = jaccard.NEAR_WORDS, jaccard.NEAR_PERCENT
#: Bands, values of each, and values that a fingerprint shows.
BANDS, DEPTH, PLACES = 32, 5, 128
SIZE = BANDS * DEPTH
#: Text of a shard and of a range of documents.
SHARD_BYTES, RANGE_BYTES = 1 << 20, 32 << 20
#: Shingles that are permuted at once.
_BLOCK = 512

_RNG = np.random.default_rng(20240611)
_A = _RNG.integers(0, 1 << 63, SIZE, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, SIZE, dtype=np.uint64)[:, None] * np.uint64(2)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
EMPTY = b"\xff" * PLACES


def signature(found: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The least value of each of the first permutations over a set of shingles; all ones for the empty set."""
    out = np.full(size, _MOST)
    for begin in range(0, len(found), _BLOCK):
        values = _A[:size] * found[begin : begin + _BLOCK]
        values += _B[:size]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def fingerprint(values: np.ndarray) -> bytes:
    """A byte of each of a signature's first values."""
    return EMPTY if (values == _MOST).all() else (jaccard._mix(values[:PLACES]) & np.uint64(255)).astype(np.uint8).tobytes()


def bands(values: np.ndarray) -> np.ndarray:
    """A hash of each band and its number."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in values.reshape(BANDS, DEPTH).T:
        out = jaccard._mix(out + jaccard._mix(row))
    return out.view(np.int64)


def likeness(a: bytes, b: bytes) -> float:
    """How similar the sets of two fingerprints are, from 0 to 1: the share of equal bytes beyond chance."""
    if a == b:
        return 1.0
    if EMPTY in (a, b):
        return 0.0
    same = float(np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)))
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many (or all) of the next."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_ROWS = (
    "part int, kind int, row bigint, doc_id bigint, text string, n_chars bigint, edited_sha256 binary, fingerprint binary, "
    "edited_fingerprint binary, near_edited double, near_next double, n bigint, member binary, bands array<bigint>"
)
_ARROW = pa.schema([
    ("part", pa.int32()), ("kind", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()),
    ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n", pa.int64()), ("member", pa.binary()), ("bands", pa.list_(pa.int64())),
])
#: Kinds of rows: whole ones, a partition's first and last document.
_WHOLE, _FIRST, _LAST = range(3)


def _compared(rows: list[tuple[int, int, str]], words: int) -> list[dict]:
    """Each row (row, doc_id, text) but the last against the next one."""
    texts = [t for *_, t in rows]
    after = [edited(a, b) for a, b in zip(texts, texts[1:])]
    sets = jaccard.shingles([t.encode() for t in texts], words)
    values = [signature(s) for s in sets]
    prints = [fingerprint(v) for v in values]
    out = []
    for k, found in enumerate(jaccard.shingles([t.encode() for t in after], words)):
        changed = fingerprint(signature(found, PLACES))
        out.append({
            "kind": _WHOLE, "row": rows[k][0], "doc_id": rows[k][1], "n_chars": len(texts[k]), "edited_sha256": hashlib.sha256(after[k].encode()).digest(), "fingerprint": prints[k],
            "edited_fingerprint": changed, "near_edited": likeness(prints[k], changed), "near_next": likeness(prints[k], prints[k + 1]), "n": len(sets[k]),
            "member": xxhash.xxh3_128_digest(sets[k].tobytes()) if len(sets[k]) else None, "bands": bands(values[k]) if len(sets[k]) else [],
        })
    return out


def _batch(rows: list[dict], part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part if f.name == "part" else r.get(f.name) for r in rows], f.type) for f in _ARROW], schema=_ARROW)


def _stream(words: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting = TaskContext.get().partitionId(), []
        for shard in common.shards(batches, 2, SHARD_BYTES):
            own = [(r, i, t or "") for r, i, t in zip(*(shard.column(k).to_pylist() for k in range(3)), strict=True)]
            if not waiting:
                yield _batch([{"kind": _FIRST, "text": own[0][2]}], part)
            rows = waiting + own
            yield _batch(_compared(rows, words), part)
            waiting = rows[-1:]
        if waiting:
            r, i, t = waiting[0]
            yield _batch([{"kind": _LAST, "row": r, "doc_id": i, "text": t}], part)

    return task


def _pairs(words: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, i, t, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _batch(_compared([(r, i, t or ""), (0, None, following or "")], words), -1)

    return task


def neighbours(docs: DataFrame, doc_id="doc_id", text="text", words: int = WORDS) -> DataFrame:
    """Every row of docs, compared with the next one in the order of ids (after the last comes the first):
    row (a key of its id and text), doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n
    (shingles), member (of its set) and bands. Written to the shared folder; texts are shuffled once."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    ranges = max(spark.sparkContext.defaultParallelism, math.ceil(size / RANGE_BYTES))
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).select(F.xxhash64("i", "t").alias("r"), "i", "t", F.monotonically_increasing_id().alias("m"))
    order = (F.col("i").asc_nulls_first(), "r", "m")
    found = common.cut(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("r", "i", "t").mapInArrow(_stream(words), _ROWS), "neighbours")
    first = found.filter(F.col("kind") == _FIRST).select("part", F.col("text").alias("following"))
    # One row per range that has rows; texts stay out of this window.
    by = W.orderBy("part")
    after = first.select("part").withColumn("then", F.coalesce(F.lead("part").over(by), F.first("part").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    last = found.filter(F.col("kind") == _LAST).select("part", "row", "doc_id", "text").join(after, "part")
    last = last.join(first.select(F.col("part").alias("then"), "following"), "then").select("row", "doc_id", "text", "following")
    return found.filter(F.col("kind") == _WHOLE).union(last.mapInArrow(_pairs(words), _ROWS)).drop("part", "kind", "text")


def near_duplicates(found: DataFrame, rows: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Of each set among `found` (row, doc_id, n, member, bands), whose texts are in rows (row, text): member,
    component_id (the least id that links lead to) and links (how many other rows one of its rows links with)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    node = F.xxhash64("member")
    members = found.filter(F.col("n") > 0).groupBy("member").agg(first.alias("first"), F.max("n").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    members = common.cut(members, "sketched-sets")
    keys = members.select(node.alias("node"), F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1).select("key", "a")
    ties = keys.join(shared, "key").filter(F.col("node") != F.col("a")).select("a", F.col("node").alias("b"))
    # A node that two sets happen to share only joins their clusters; links are decided on sets.
    clusters = graph.components(ties).withColumnRenamed("node", "__node")
    placed = members.join(clusters, node == F.col("__node"), "left").select("member", "first", "n", "copies", F.coalesce("label", node).alias("root"))
    named = jaccard.verified(rows, common.cut(placed, "placed"), words, percent)
    least = named.groupBy("label").agg(F.min("first.doc_id").alias("component_id"))
    return named.join(least, "label").select("member", "component_id", "links")


def op11(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text and its near duplicates, by the contract of op11."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = neighbours(docs)
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), "text")
    near = near_duplicates(found, rows).withColumnRenamed("member", "__member")
    out = found.join(near, F.col("member") == F.col("__member"), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select("doc_id", "n_chars", text("edited_sha256"), text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next", component.alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))

"""Exact removal of repeated passages with suffix arrays.

Every byte that lies in a LENGTH-byte string which also starts anywhere else, in the same text or
another, is removed. Suffix arrays decide that, in shards of bounded size into which all places that
could repeat each other are brought:

 1. Each window of LENGTH bytes is named by its anchor, the leftmost of its least grams (GRAM bytes, in
    an order of hashes). Equal windows have equal anchors. Windows in a row with one anchor are one
    segment, about half a window long beyond LENGTH.
 2. Texts count once, with their number of copies, and so do segments of equal content. An anchor with
    one segment in one place is done with: nothing repeats its windows.
 3. The distinct segments of each other anchor are brought together. A shard's suffix array, made by
    induced sorting, and its permuted common prefixes tell which windows occur twice in it. What an
    anchor with very many segments has is dealt to several shards; each of them settles what repeats
    within, and one hash for each distinct window that is left joins them.
 4. A segment's repeated windows hold wherever the segment occurs; they are gathered per text.

Nulls: a null text is empty; a null id is kept. Texts shorter than LENGTH lose nothing. Repeated rows
and repeated ids each keep their row, and repeat each other's bytes. Matches never cross texts. Empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantia.llm import common, suffix_array

#: Bytes of a repeated string, of a gram; of a text shard and of a suffix array's shard.
LENGTH, GRAM = 400, 200
SHARD_BYTES, ARRAY_BYTES = 1 << 20, 1 << 20
#: Distinct segments of one anchor that meet in one shard.
MEET = 4000

_CHUNK = 1 << 18
_RNG = np.random.default_rng(20240608)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _CHUNK + LENGTH + 1), _powers(_INVERSE, _CHUNK + LENGTH + 1)


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram, well mixed."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * _UP[: len(data)])])
    h = (sums[gram:] - sums[:-gram]) * _DOWN[: len(data) - gram + 1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window: where its anchor is, and the anchor gram's hash."""
    places, hashes = [], []
    span, windows = length - gram + 1, len(data) - length + 1
    for begin in range(0, windows, _CHUNK):
        part = data[begin : begin + _CHUNK + length - 1]
        h = _grams(part, gram)
        key = (h & ~np.uint64((1 << 23) - 1)) | np.arange(len(h), dtype=np.uint64)
        n = len(key) - span + 1
        padded = np.append(key, np.full(-len(key) % span, np.uint64(_MASK))).reshape(-1, span)
        to_right = np.minimum.accumulate(padded, axis=1).ravel()
        to_left = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(to_left[:n], to_right[span - 1 : span - 1 + n])
        at = (least & np.uint64((1 << 23) - 1)).astype(np.int64)
        places.append(at + begin)
        hashes.append(h[at])
    return np.concatenate(places), np.concatenate(hashes)


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor hash) of each segment, by texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    none = np.zeros(0, np.int64)
    if not (sizes >= length).any():
        return none, none, none, none
    data = np.frombuffer(b"".join(texts), np.uint8)
    at, name = anchors(data, length, gram)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    text = np.searchsorted(ends, np.arange(len(at)), "right")
    inside = np.arange(len(at)) + length <= ends[text]
    window = np.flatnonzero(inside)
    new = np.ones(len(window), bool)
    new[1:] = (at[window[1:]] != at[window[:-1]]) | (text[window[1:]] != text[window[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(window)))
    w = window[first]
    return text[w], w - starts[text[w]], count, name[w].view(np.int64)


_SCAN = "doc_id bigint, sha string, n_bytes bigint, parts array<struct<anchor:bigint,part:bigint,n:int,starts:array<int>>>"
_PART = pa.struct([("anchor", pa.int64()), ("part", pa.int64()), ("n", pa.int32()), ("starts", pa.list_(pa.int32()))])


def _scanner(length: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in common.shards(batches, 1, SHARD_BYTES):
            texts = common.utf8(shard.column(1))
            text, start, n, anchor = segments(texts, length, gram)
            part = np.array([xxhash.xxh3_64_intdigest(texts[t][a : a + k + length - 1]) for t, a, k in zip(text.tolist(), start.tolist(), n.tolist(), strict=True)], np.uint64).view(np.int64)
            # A text's equal segments are one, with all its places: texts that repeat a word have thousands.
            order = np.lexsort((start, part, anchor, text))
            text, start, n, anchor, part = (x[order] for x in (text, start, n, anchor, part))
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
            first = np.flatnonzero(new)
            starts = pa.ListArray.from_arrays(pa.array(np.append(first, len(text)), pa.int32()), pa.array(start, pa.int32()))
            offsets = np.searchsorted(text[first], np.arange(len(texts) + 1)).astype(np.int32)
            parts = pa.StructArray.from_arrays([pa.array(anchor[first], pa.int64()), pa.array(part[first], pa.int64()), pa.array(n[first], pa.int32()), starts], fields=list(_PART))
            out = pa.table({"doc_id": shard.column(0), "sha": [hashlib.sha256(t).hexdigest() for t in texts], "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "parts": pa.ListArray.from_arrays(pa.array(offsets), parts)})
            yield from out.to_batches()

    return scan


def _cutter(length: int):
    """The bytes of the segments that are asked for, from their texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in common.shards(batches, 0, SHARD_BYTES):
            rows = [(w["anchor"], w["part"], w["shard"], w["hot"], t[w["start"] : w["start"] + w["n"] + length - 1]) for t, ws in zip(common.utf8(shard.column(0)), shard.column(1).to_pylist(), strict=True) for w in ws]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield from pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "part", "shard", "hot", "bytes"]).to_batches()

    return task


def repeated(pieces: list[bytes], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each piece its windows that occur twice in the pieces, and the windows before which no equal
    one stands in the suffix array: one of each distinct window."""
    data = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.int64) + 1, 0) for p in pieces])
    sizes = np.array([len(p) + 1 for p in pieces])
    ends = np.cumsum(sizes)
    room = np.repeat(ends - 1, sizes) - np.arange(len(data))
    order = suffix_array.suffix_array(data)
    prefix, before = suffix_array.common_prefixes(np.maximum(data - 1, 0), order, room)
    again = np.flatnonzero(prefix >= length)
    twice = np.zeros(len(data), bool)
    twice[again] = twice[before[again]] = True
    one = (room >= length) & (prefix < length)
    starts = ends - sizes
    cut = lambda x: [np.flatnonzero(x[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return cut(twice), cut(one)


_FOUND = "anchor bigint, part bigint, first int, last int, name binary, lone boolean"


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.append(0, cuts + 1)].tolist(), at[np.append(cuts, len(at) - 1)].tolist(), strict=True))


def _arrays(length: int):
    """Each task's pieces, sorted by shard, in suffix arrays of bounded size; one anchor's pieces (of one
    shard) are never parted."""

    def solve(rows: list[tuple]) -> list[tuple]:
        rows = sorted({(a, p): (a, p, s, hot, b) for a, p, s, hot, b in rows}.values())
        twice, one = repeated([r[4] for r in rows], length)
        out = []
        for (anchor, part, _, hot, data), again, single in zip(rows, twice, one, strict=True):
            out += [(anchor, part, a, b, None, None) for a, b in _runs(again)]
            if hot:
                settled = set(again.tolist())
                out += [(anchor, part, w, w, xxhash.xxh3_128_digest(data[w : w + length]), w not in settled) for w in single.tolist()]
        return out

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        total, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if total > ARRAY_BYTES and row[2] != last:
                    yield _found(solve(waiting))
                    waiting, total = [], 0
                waiting.append(row)
                total, last = total + len(row[4]), row[2]
        if waiting:
            yield _found(solve(waiting))

    return task


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "part", "first", "last", "name", "lone"])


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: bytes and runs removed, and a hash of what is left."""
    for shard in common.shards(batches, 1, SHARD_BYTES):
        out = []
        for text, spans in zip(common.utf8(shard.column(1)), shard.column(2).to_pylist(), strict=True):
            kept, at, runs, removed = hashlib.sha256(), 0, 0, 0
            for begin, end in merged((s["begin"], s["end"]) for s in spans):
                kept.update(text[at:begin])
                at, runs, removed = end, runs + 1, removed + end - begin
            kept.update(text[at:])
            out.append((removed, runs, kept.hexdigest()))
        removed, runs, kept = zip(*out, strict=True)
        yield from pa.table([shard.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string())], names=["sha", "n_removed", "n_spans", "kept_sha256"]).to_batches()


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def remove_repeats(docs: DataFrame, doc_id="doc_id", text="text", length: int = LENGTH, gram: int = GRAM, meet: int = MEET) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    scan = common.cut(rows.mapInArrow(_scanner(length, gram), _SCAN), "segments")

    # Distinct texts with their copies; segments in two places or more, and anchors with several segments.
    texts = scan.filter(F.size("parts") > 0).groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("owner"), F.first("parts").alias("parts"))
    texts = common.cut(texts, "texts")
    places = texts.select("sha", "owner", "copies", F.inline("parts")).withColumn("copies", F.col("copies") * F.size("starts"))
    busy = places.groupBy("anchor").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.sum("copies").alias("times"))
    busy = busy.filter((F.col("lo") != F.col("hi")) | (F.col("times") > 1)).select("anchor", (F.col("lo") != F.col("hi")).alias("several"))
    busy = places.join(busy, "anchor")
    busy = common.cut(busy, "busy")
    whole = busy.groupBy("anchor", "part").agg(F.sum("copies").alias("times"), F.max("several").alias("several"), F.min(F.struct("sha", F.col("starts")[0].alias("start"), "owner", "n")).alias("at"))
    whole = common.cut(whole.select("anchor", "part", "times", "several", "at.*"), "parts")

    # One place of each distinct segment, brought to the shard of its anchor; hot anchors go to several.
    crowd = whole.filter("several").groupBy("anchor").agg(F.count(F.lit(1)).alias("parts")).select("anchor", F.ceil(F.col("parts") / meet).cast("long").alias("shards"))
    wanted = whole.filter("several").join(crowd, "anchor")
    shard = F.xxhash64("anchor", F.when(F.col("shards") > 1, F.pmod(F.xxhash64("part"), F.col("shards"))).otherwise(F.lit(0).cast("long")))
    ask = wanted.groupBy("sha", "owner").agg(F.collect_list(F.struct("anchor", "part", shard.alias("shard"), (F.col("shards") > 1).alias("hot"), "start", "n")).alias("ask"))
    # Texts that segments are cut from, or that lose a part and not all: once each, from the owner's row.
    losing = busy.select("sha", "owner").distinct()
    need = losing.join(ask.drop("owner"), "sha", "left").withColumn("ask", F.coalesce("ask", F.expr("cast(array() as array<struct<anchor:bigint,part:bigint,shard:bigint,hot:boolean,start:int,n:int>>)")))
    hashed = rows.withColumn("__sha", F.sha2(F.col("text").cast("binary"), 256))
    held = hashed.join(need.withColumnRenamed("owner", "__owner"), (F.col("__sha") == F.col("sha")) & F.col("doc_id").eqNullSafe(F.col("__owner"))).select("sha", "__owner", "text", "ask")
    # An owner's row may stand in the table many times; one of them is enough. Rows are dealt by these keys already.
    held = held.withColumn("__n", F.row_number().over(W.partitionBy("sha", "__owner").orderBy("sha"))).filter("__n = 1").select("sha", "text", "ask")
    held = common.cut(held, "held")
    pieces = held.filter(F.size("ask") > 0).select("text", "ask").mapInArrow(_cutter(length), "anchor bigint, part bigint, shard bigint, hot boolean, bytes binary")
    found = common.cut(pieces.repartition("shard").sortWithinPartitions("shard").mapInArrow(_arrays(length), _FOUND), "found")

    met = found.filter("name is not null").groupBy("anchor", "name").agg(F.count(F.lit(1)).alias("shards")).filter("shards > 1")
    across = found.filter("lone").join(met, ["anchor", "name"]).select("anchor", "part", "first", "last")
    within = found.filter("name is null").select("anchor", "part", "first", "last")
    full = whole.filter("times > 1").select("anchor", "part", F.lit(0).alias("first"), (F.col("n") - 1).alias("last"))
    windows = within.union(across).union(full)
    spans = busy.select("sha", "anchor", "part", "starts").join(windows, ["anchor", "part"]).withColumn("start", F.explode("starts"))
    span = F.struct((F.col("start") + F.col("first")).alias("begin"), (F.col("start") + F.col("last") + length).alias("end"))
    spans = spans.groupBy("sha").agg(F.collect_set(span).alias("spans"))
    lost = held.join(spans, "sha").select("sha", "text", "spans").mapInArrow(_remover, "sha string, n_removed bigint, n_spans bigint, kept_sha256 string").dropDuplicates(["sha"])
    out = scan.select("doc_id", "sha", "n_bytes").join(lost.withColumnRenamed("sha", "__lost"), F.col("sha") == F.col("__lost"), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def op6(spark, sf_dir: str) -> DataFrame:
    """What exact deduplication removes of every document, by the contract of op6."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))

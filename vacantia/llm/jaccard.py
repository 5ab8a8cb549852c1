"""N-gram Jaccard join by grouped prefixes.

A document is its set of distinct word shingles, as 64-bit hashes. In one order of all shingles, rarest
first, two sets that are similar enough share k of their first n - ceil(t n) + k shingles, their
prefixes (or all, if they have fewer). Documents with one prefix and size form a group; groups that share a prefix shingle are
filtered into candidate clusters; the clusters' members are expanded and verified on their whole sets.

 1. Every shingle of every document is counted in a hashed table that grows with the text up to a bound
    (so some counts are too high, alike for all), of which orders of magnitude are kept. Any order is
    right; this one keeps what is common out of the prefixes.
 2. Documents with one set are one member from here on. Groups that hold a prefix shingle are paired
    and filtered by size and by the shingles that they share; where more than FEW hold one, each is
    tied to the least of them, which leaves as many ties as rows, not as pairs.
 3. Clusters of paired or tied groups are verified, small ones in one task each. A large one is dealt in blocks,
    and each two blocks meet in a task of bounded size; so no cluster is too large, and none is cut.
    A task gives a spanning forest of the links it finds, not all of them, and how many each member has.
 4. Links make components. Similarity is only ever decided on pairs of sets.

Nulls: a null text, or one without words, has no shingles and links with nothing; a null id still has a
component, whose name is the least id in it (null if there is none). Texts of fewer words than a
shingle are one shingle. Repeated rows and repeated ids each keep their row; texts of members are found
again by a key of their row, never by id alone. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm import common, graph

#: Words of a shingle, least similarity in percent: of the contract, and of near duplicates elsewhere.
WORDS, PERCENT = 3, 90
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Shingles that candidates' prefixes share, and groups that hold one and are still paired.
SHARED, FEW = 3, 128
#: Bits of the table of counts, least and most (1 byte each is broadcast: 16 MB at 24), and text for each of them.
COUNT_BITS, MOST_BITS, SLOT_BYTES = 20, 24, 1024
#: Text of a shard, and work and shingles of a task.
SHARD_BYTES = 1 << 20
TASK_WORK, TASK_SHINGLES = 2_000_000_000, 2_000_000
#: Places of holders that are counted at once.
_HOLDERS = 500_000

#: Spark makes a Bloom filter of a join's smaller side if that is of this size at most; else all rows are shuffled.
_FILTERED = {f"spark.sql.optimizer.runtime.bloomFilter.{k}": v for k, v in (("enabled", "true"), ("applicationSideScanSizeThreshold", "0"), ("creationSideThreshold", "256m"), ("numBits", str(1 << 24)), ("expectedNumItems", "2000000"))}

_CHUNK = 1 << 14
#: Letters that are hashed at once, and of a word that is hashed by itself.
_PIECE, _LONG = 1 << 20, 4096
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), 0x9E3779B97F4A7C15, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_LONG + 1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z in lower case, and how many each text has."""
    data = np.frombuffer(b"\n" + b"\n".join(t.lower() for t in texts) + b"\n", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    edges = np.cumsum([0, *[len(t) + 1 for t in texts]])
    counts = np.diff(np.searchsorted(starts, edges + 1))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lengths = ends - starts
    hashes = np.empty(len(starts), np.uint64)
    for i in np.flatnonzero(lengths > _LONG).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    short = np.flatnonzero(lengths <= _LONG)
    letters = np.cumsum(lengths[short])
    for part in np.split(short, np.searchsorted(letters, np.arange(_PIECE, letters[-1] if len(letters) else 0, _PIECE))):
        if len(part):
            n = lengths[part]
            offsets = np.cumsum(n) - n
            place = np.arange(n.sum()) - np.repeat(offsets, n)
            sums = np.add.reduceat(_BYTE[data[np.repeat(starts[part], n) + place]] * _POWERS[place], offsets)
            hashes[part] = _mix(sums + n.astype(np.uint64))
    return hashes, counts


def shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Each text's distinct shingles in ascending order of their hashes."""
    hashes, counts = word_hashes(texts)
    n_whole = max(0, len(hashes) - words + 1)
    whole = np.zeros(n_whole, np.uint64)
    for i in range(words):
        whole = _mix(whole + hashes[i : i + n_whole])
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(whole[at : at + n - words + 1]))
        else:
            short = np.zeros(min(n, 1), np.uint64)
            for h in hashes[at : at + n]:
                short = _mix(short + h)
            out.append(short)
        at += n
    return out


def prefix_length(n: int, percent: int) -> int:
    """Of sets that link, the SHARED first common shingles (or all, if fewer) are in both prefixes."""
    return min(n, n - -(-percent * n // 100) + SHARED)


def _counter(words: int, bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for shard in common.shards(batches, 0, SHARD_BYTES):
            for found in shingles(common.utf8(shard.column(0)), words):
                np.add.at(total, (found >> np.uint64(64 - bits)).astype(np.int64), 1)
        parts = total.reshape(-1, min(_CHUNK, len(total)))
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(used, pa.int32()), "counts": pa.array([parts[i].tobytes() for i in used], pa.binary())})

    return count


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of each chunk, as eighths of their order of magnitude in one byte."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            add = np.frombuffer(counts, np.uint32).astype(np.int64)
            total[chunk] = total.get(chunk, 0) + add
    yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(total), pa.int32()), "counts": pa.array([np.minimum(np.round(8 * np.log2(t + 1)), 255).astype(np.uint8).tobytes() for t in total.values()], pa.binary())})


def shingle_counts(docs: DataFrame, text: str, words: int, bits: int | None = None) -> np.ndarray:
    """In how many documents shingles occur, about, by the first bits of their hashes, over all documents."""
    kind = "chunk int, counts binary"
    if bits is None:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        bits = min(MOST_BITS, max(COUNT_BITS, math.ceil(math.log2(size / SLOT_BYTES + 1))))
    rows = docs.select(text).mapInArrow(_counter(words, bits), kind).repartition(max(1, (1 << bits) // _CHUNK), "chunk").mapInArrow(_summed, kind)
    out = np.zeros((max(1, (1 << bits) // _CHUNK), min(_CHUNK, 1 << bits)), np.uint8)
    for chunk, counts in rows.collect():
        out[chunk] = np.frombuffer(counts, np.uint8)
    return out.ravel()


_MEMBERS = "row bigint, doc_id bigint, n bigint, member binary, grp bigint, prefix array<bigint>"


def _members(words: int, percent: int, counts):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        shift = np.uint64(64 - int(len(table)).bit_length() + 1)
        for shard in common.shards(batches, 2, SHARD_BYTES):
            sizes, members, groups, prefixes = [], [], [], []
            for found in shingles(common.utf8(shard.column(2)), words):
                n = len(found)
                sizes.append(n)
                if not n:
                    members.append(None)
                    groups.append(None)
                    prefixes.append([])
                    continue
                # Counts first, hashes within; found ascends, so a stable sort settles what the key leaves out.
                key = (table[(found >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (found >> np.uint64(8))
                prefix = found[np.argsort(key, kind="stable")[: prefix_length(n, percent)]].view(np.int64)
                members.append(xxhash.xxh3_128_digest(found.tobytes()))
                groups.append(xxhash.xxh3_64_intdigest(prefix.tobytes() + n.to_bytes(8, "little")) - (1 << 63))
                prefixes.append(prefix)
            out = pa.table({"row": shard.column(0), "doc_id": shard.column(1), "n": pa.array(sizes, pa.int64()), "member": pa.array(members, pa.binary()), "grp": pa.array(groups, pa.int64()), "prefix": pa.array(prefixes, pa.list_(pa.int64()))})
            yield from out.to_batches()

    return task


def _candidates(found: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups (a, b) that may link, or that hold such a pair's clusters together.

    Where few groups hold a shingle, all pairs of fitting sizes count it, and pairs that share as many as
    linking takes are kept. Where many do, each is tied to the least of them instead.
    """
    keys = found.filter(F.col("n") > 0).dropDuplicates(["grp"]).select("grp", "n", F.explode("prefix").alias("key"))
    held = common.cut(keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1), "key"), "shared-keys")
    few = held.filter(F.col("m") <= FEW).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "grp"))).alias("g"))
    fits = lambda x: lambda y: 100 * x["n"] >= percent * y["n"]
    pair = lambda x: lambda y: F.struct(F.least(x["grp"], y["grp"]).alias("a"), F.greatest(x["grp"], y["grp"]).alias("b"), y["n"].alias("n"))
    later = lambda i: F.slice(F.col("g"), i + F.lit(2), F.size("g"))
    pairs = few.select(F.inline(F.flatten(F.transform("g", lambda x, i: F.transform(F.filter(later(i), fits(x)), pair(x))))))
    shared = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    shared = shared.filter(F.col("k") >= F.least(F.lit(SHARED), F.ceil(F.col("n") * percent / 100))).select("a", "b")
    many = held.filter(F.col("m") > FEW)
    tied = many.join(many.groupBy("key").agg(F.min("grp").alias("a")), "key").filter(F.col("grp") != F.col("a")).select("a", F.col("grp").alias("b"))
    return shared.union(tied)


def _forest(sets: list[np.ndarray], copies: np.ndarray, first: int, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges of a spanning forest of the similar pairs, and of each set the copies of those it is similar to.
    Intersections with all others come from the lists of who holds each of a set's shingles. The first
    so many sets are one block and the others another; if that is not none, only pairs of both count."""
    sizes = np.array([len(s) for s in sets])
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    token, owner = token.astype(np.int32), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    shared = df[token] > 1
    token, owner = token[shared], owner[shared]
    held = owner[np.argsort(token, kind="stable")]
    begin = np.cumsum(np.where(df > 1, df, 0)) - np.where(df > 1, df, 0)
    own = np.searchsorted(owner, np.arange(len(sets) + 1))
    root = np.arange(len(sets))
    edges, links = [], np.zeros(len(sets), np.int64)
    for y in range(first or len(sets) - 1):
        mine = token[own[y] : own[y + 1]]
        cost = np.cumsum(df[mine])
        both = np.zeros(len(sets), np.int64)
        for lo in range(0, int(cost[-1]) if len(cost) else 0, _HOLDERS):
            part = mine[(cost > lo) & (cost <= lo + _HOLDERS)]
            n = df[part]
            both += np.bincount(held[np.repeat(begin[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(sets))
        rest = slice(first or y + 1, None)
        linked = np.flatnonzero(100 * both[rest] >= percent * (sizes[rest] + sizes[y] - both[rest])) + rest.start
        links[y] += copies[linked].sum()
        links[linked] += copies[y]
        for r in np.unique(root[linked]).tolist():
            if r != root[y]:
                edges.append((y, int(linked[root[linked] == r][0])))
                root[root == r] = root[y]
    return edges, links


def _verify(percent: int):
    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("member", "ascending")])
        names = table.column("member").to_pylist()
        one = [i for i, m in enumerate(names) if not i or m != names[i - 1]]
        sets = [np.frombuffer(table.column("set")[i].as_py(), np.uint64) for i in one]
        sides = table.column("side").to_numpy()[one]
        copies = table.column("copies").to_numpy()[one]
        # A task of two blocks that got only one of them has nothing to do.
        alone = table.column("i")[0].as_py() != table.column("j")[0].as_py() and (sides == sides[0]).all()
        edges, links = ([], np.zeros(0, np.int64)) if alone or len(sets) < 2 else _forest(sets, copies, int((sides == 0).sum()) if sides[-1] else 0, percent)
        has = np.flatnonzero(links)
        a = [names[one[a]] for a, _ in edges] + [names[one[k]] for k in has.tolist()]
        b = [names[one[b]] for _, b in edges] + [None] * len(has)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "n": pa.array([0] * len(edges) + links[has].tolist(), pa.int64())})

    return task


def _expand(words: int):
    """Whole sets of the rows that stand for a member, for each of the tasks that the member meets."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for shard in common.shards(batches, 0, SHARD_BYTES):
            cols = [shard.column(c).to_pylist() for c in ("member", "copies", "root", "blocks", "block")]
            out: list[tuple] = []
            size = 0
            for found, member, copies, root, blocks, block in zip(shingles(common.utf8(shard.column(0)), words), *cols, strict=True):
                data = found.tobytes()
                if member in told or xxhash.xxh3_128_digest(data) != member:
                    continue  # a copy of the row, or another row with this key
                told.add(member)
                for b in range(blocks):
                    i, j = min(block, b), max(block, b)
                    out.append((root, i, j, int(block != i), member, copies, data))
                    size += len(data)
                    if size > SHARD_BYTES:
                        yield _rows(out)
                        out, size = [], 0
                if len(out) > 256:
                    yield _rows(out)
                    out, size = [], 0
            yield _rows(out)

    return task


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * 7
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["root", "i", "j", "side", "member", "copies", "set"])


def _linked(rows: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (row, doc_id, text) what they are (_MEMBERS), and of each member (member, label, first, links):
    its component, its own first row (no id, doc_id, row) by id, null ids last, and then by key, and the
    rows that each of its own links with."""
    spark = rows.sparkSession
    counts = spark.sparkContext.broadcast(shingle_counts(rows, "text", words))
    found = common.cut(rows.select("row", "doc_id", "text").mapInArrow(_members(words, percent, counts), _MEMBERS), "shingle-members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    members = found.filter(F.col("n") > 0).groupBy("member").agg(first.alias("first"), F.max("n").alias("n"), F.max("grp").alias("grp"), F.count(F.lit(1)).alias("copies"))
    members = common.cut(members, "distinct-sets")

    clusters = graph.components(_candidates(found, percent))

    placed = members.join(clusters, F.col("grp") == F.col("node"), "left").select("member", "first", "n", "copies", F.coalesce("label", "grp").alias("root"))
    return found, verified(rows, common.cut(placed, "placed"), words, percent)


def verified(rows: DataFrame, placed: DataFrame, words: int, percent: int) -> DataFrame:
    """Of each member in placed (member, first, n, copies, root: its candidates' cluster) what _linked gives, by its
    whole set: links are decided between all members of a cluster, whose texts are found in rows (row, text)."""
    sizes = placed.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).filter(F.col("m") > 1)
    work = F.col("m").cast("double") * F.col("s")
    blocks = F.greatest(F.ceil(2 * F.sqrt(work / TASK_WORK)), F.ceil(2 * F.col("s") / TASK_SHINGLES))
    sizes = sizes.select("root", F.when((work <= TASK_WORK) & (F.col("s") <= TASK_SHINGLES), 1).otherwise(F.greatest(F.lit(2), blocks)).cast("int").alias("blocks"))
    open_ = common.cut(placed.join(sizes, "root").select(F.col("first.row").alias("__row"), "member", "copies", "root", "blocks", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int").alias("block")), "open-members")
    # Few rows are in clusters, so Spark filters the texts by these keys before it shuffles them.
    open_ = open_.filter(F.col("blocks") >= 1)
    texts = rows.join(open_, F.col("row") == F.col("__row")).select("text", "member", "copies", "root", "blocks", "block")
    sets = texts.mapInArrow(_expand(words), "root bigint, i int, j int, side int, member binary, copies bigint, set binary")
    edges = common.cut(sets.groupBy("root", "i", "j").applyInArrow(_verify(percent), "a binary, b binary, n bigint"), "links", _FILTERED)
    linked = graph.components(edges.filter("b is not null").select("a", "b"))
    others = edges.filter("b is null").groupBy(F.col("a").alias("__of")).agg(F.sum("n").alias("__others"))
    named = placed.join(linked, F.col("member") == F.col("node"), "left").join(others, F.col("member") == F.col("__of"), "left")
    links = F.col("copies") - 1 + F.coalesce("__others", F.lit(0))
    return named.select("member", F.coalesce("label", "member").alias("label"), "first", links.alias("links"))


def link(docs: DataFrame, doc_id="doc_id", text="text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row: the least id that links lead to, its own
    included, and how many other rows it links with itself."""
    common.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Rows with one key are copies, or differ in their sets, which tells them apart.
    found, named = _linked(rows.withColumn("row", F.xxhash64("doc_id", "text")), words, percent)
    least_id = named.groupBy("label").agg(F.min("first.doc_id").alias("component_id"))
    of_member = named.join(least_id, "label").select(F.col("member").alias("__member"), "component_id", "links")
    out = found.select("doc_id", "n", "member").join(of_member, F.col("member") == F.col("__member"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def deduplicated(docs: DataFrame, doc_id="doc_id", text="text", words: int = NEAR_WORDS, percent: int = NEAR_PERCENT) -> DataFrame:
    """docs with exactly one row of each group of linked ones: of those with the group's least id (null only
    if it has no other) the first in the table as it is read here. Rows without words link with nothing, so
    each of them stays. Every row counts by itself, whatever rows share its id."""
    common.bounded_batches(docs.sparkSession)
    keyed = common.cut(docs.withColumn("__row", F.monotonically_increasing_id()), "keyed-rows")
    rows = keyed.select(F.col("__row").alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found, named = _linked(rows, words, percent)
    first = named.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.row").alias("__kept"))
    kept = first.union(found.filter(F.col("n") == 0).select("row"))
    return keyed.join(kept, F.col("__row") == F.col("__kept"), "left_semi").drop("__row")


def op10(spark, sf_dir: str) -> DataFrame:
    """Components of similar documents, by the contract of op10."""
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Benchmark decontamination with training suffix arrays.

Documents are read in shards of bounded size. Each shard gets the suffix array of all its words, and
every suffix of the benchmark's items is binary-searched in it. Where it lands tells two things:

 * the neighbours there bound its longest verbatim match, and of what stands between two landings in a
   row the nearer one is the longest match of that place of a document;
 * the range that begins with its first words (a window of them) lists all occurrences of that window.

With a benchmark of one block no document is shuffled. A larger one takes a pass over the documents for each
block of items of bounded size; passes write what they find by a key of the row, and meet in one join. A window that many items share is searched
once and keeps the list of its items.

Nulls: a null text has no words; a null item id is searched like others but not listed. Empty items
match nothing. Repeated items with one id count as one. Very long texts are a shard of their own.
Empty tables give empty results, and other columns of the documents pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm import common

#: Words of a window, and the share of hit words (1 in 20) from which a document is contaminated.
WINDOW, SHARE = 13, 20
#: Bytes of text in a shard, and bytes of items searched in one pass over the documents.
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 4 << 20

#: A-Z become lower case; every ASCII byte that is no letter or digit separates words.
_FOLD = bytes(b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Numbers(dict):
    """Numbers of words from 0 in the order in which they are first met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(texts: list[list[bytes]], numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, ends): words of the texts as numbers from len(texts) on, each text with an end mark of its own
    behind it that is less than any word, and where those stand."""
    flat: list[int] = []
    ends = []
    for own in texts:
        flat.extend(map(numbers.__getitem__, own))
        ends.append(len(flat))
        flat.append(-1)
    tokens = np.array(flat, np.int64) + len(texts)
    tokens[ends] = np.arange(len(texts))
    return tokens, np.array(ends, np.int64)


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. They are sorted by as many words as fit into 62 bits; those that
    are equal so far are sorted on by the rank of the suffix behind what is known, which doubles it."""
    n = len(tokens)
    if n < 2:
        return np.arange(n)
    base = int(tokens.max()) + 2
    known = max(1, int(62 / np.log2(base)))
    padded = np.append(tokens + 1, np.zeros(known, np.int64))
    key = np.zeros(n, np.int64)
    for i in range(known):
        key = key * base + padded[i : i + n]
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            return order
        at = order[tied]
        behind = rank[np.minimum(at + known, n)]
        by = np.lexsort((behind, rank[at]))
        at, behind = at[by], behind[by]
        order[tied] = at
        group = rank[at]
        new[tied] = np.append(True, (group[1:] != group[:-1]) | (behind[1:] != behind[:-1]))
        rank[at] = np.maximum.accumulate(np.where(new[tied], tied, 0))
        known *= 2


def _shared(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words a from `at` on and b from `bt` on share, `most` at most."""
    out = np.zeros(len(at), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        live = live[a[at[live] + out[live]] == b[bt[live] + out[live]]]
        out[live] += 1
        live = live[out[live] < most[live]]
    return out


class Items:
    """A block of benchmark items: their suffixes in order, and their distinct windows, each with its items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.window, self.numbers = window, Numbers()
        self.names = [name for name, _ in items]
        self.tokens, ends = numbered([words(text) for _, text in items], self.numbers)
        self.base = len(items)
        begins = np.append(0, ends[:-1] + 1) if len(ends) else ends
        owner = np.repeat(np.arange(len(items)), ends + 1 - begins)
        # Room: words up to the item's end. Windows are suffixes with room for one, or whole shorter items.
        order = suffix_array(self.tokens)
        order = order[self.tokens[order] >= self.base]
        room = ends[owner[order]] - order
        before = np.append(0, _shared(self.tokens, order[:-1], self.tokens, order[1:], np.minimum(room[:-1], room[1:])))
        self.order, self.room, self.owner, self.at = order, room, owner[order], order - begins[owner[order]]
        size = np.where(room >= window, window, np.where(self.at == 0, room, 0))
        self.starts, self.sizes, self.of = [], [], []
        for n in np.unique(size[size > 0]).tolist():
            # Suffixes in order that share n words are together, and so are equal windows.
            mine = np.flatnonzero(size == n)
            least = np.minimum.reduceat(before[: mine[-1] + 1], np.append(0, mine[:-1] + 1))
            new = np.append(True, least[1:] < n)
            for own in np.split(mine, np.flatnonzero(new)[1:]):
                self.starts.append(int(order[own[0]]))
                self.sizes.append(n)
                self.of.append(np.unique(self.owner[own]))
        self.starts, self.sizes = np.array(self.starts, np.int64), np.array(self.sizes, np.int64)


class Shard:
    """The suffix array of a shard's words."""

    def __init__(self, texts: list[bytes], items: Items):
        own = [words(t) for t in texts]
        self.counts = [len(w) for w in own]
        numbers = Numbers(items.numbers)
        self.tokens, ends = numbered(own, numbers)
        self.items, self.ends = items, ends
        # End marks of texts and of items both lie below the words, whose numbers differ by this.
        self.shift = len(texts) - items.base
        self.order = suffix_array(self.tokens)

    def bound(self, starts: np.ndarray, sizes: np.ndarray, right: bool) -> np.ndarray:
        """Where, in the order of the suffixes, the items' words [start, start + size) would stand, left or right of
        the suffixes that begin with them."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.order), np.int64)
        query = self.items.tokens
        while len(live := np.flatnonzero(low < high)):
            mid = (low[live] + high[live]) // 2
            at, start = self.order[mid], starts[live]
            same = _shared(self.words, at, query, start, np.minimum(sizes[live], len(self.tokens) - at))
            whole = same == sizes[live]
            past = at + same >= len(self.tokens)
            mine = self.words[np.minimum(at + same, len(self.tokens) - 1)]
            theirs = query[np.minimum(start + same, len(query) - 1)]
            after = np.where(whole, right, past | (mine < theirs))
            low[live], high[live] = np.where(after, mid + 1, low[live]), np.where(after, high[live], mid)
        return low

    @property
    def words(self) -> np.ndarray:
        """Tokens in the items' numbers; end marks are less than any of theirs."""
        if not hasattr(self, "_words"):
            self._words = np.where(self.tokens >= len(self.ends), self.tokens - self.shift, -1)
        return self._words

    def occurrences(self) -> tuple[np.ndarray, ...]:
        """(place, window) of all occurrences of windows."""
        items = self.items
        low, high = self.bound(items.starts, items.sizes, False), self.bound(items.starts, items.sizes, True)
        n = high - low
        window = np.repeat(np.arange(len(n)), n)
        return self.order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())], window

    def longest(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, suffix) of the longest match of each place: the nearer of the two items' suffixes, by
        their number in the items' order, that land around it."""
        items = self.items
        landed = self.bound(items.order, items.room, False)
        rank = np.zeros(len(self.tokens), np.int64)
        rank[self.order] = np.arange(len(self.order))
        following = np.searchsorted(landed, rank[places], "right")
        best, who = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        for suffix in (following - 1, following):
            there = np.flatnonzero((suffix >= 0) & (suffix < len(landed)))
            s = suffix[there]
            n = _shared(self.words, places[there], items.tokens, items.order[s], np.minimum(items.room[s], len(self.tokens) - places[there]))
            better = n > best[there]
            best[there[better]], who[there[better]] = n[better], s[better]
        return best, who


_MATCH = T.StructType([T.StructField("item", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("item_at", "at", "n"))])
_KINDS = T.StructType([T.StructField("__hit_words", T.LongType()), T.StructField("__hit_matches", T.ArrayType(_MATCH)), T.StructField("__hit_items", T.ArrayType(T.StringType()))])
_ARROW = pa.schema([("__hit_words", pa.int64()), ("__hit_matches", pa.list_(pa.struct([("item", pa.string()), ("item_at", pa.int64()), ("at", pa.int64()), ("n", pa.int64())]))), ("__hit_items", pa.list_(pa.string()))])


def matches(texts: list[bytes], items: Items) -> pa.Table:
    """Of each text its words, its longest matches (item, where in it, where in the text, words) and the
    items of which windows occur. A match that goes on from the word before is part of that one."""
    shard = Shard(texts, items)
    place, window = shard.occurrences()
    text = np.searchsorted(shard.ends, place)
    begins = np.append(0, shard.ends[:-1] + 1) if len(texts) else shard.ends
    # Items: those of a text's distinct windows.
    pair = np.unique(text * max(1, len(items.starts)) + window)
    names = [[] for _ in texts]
    for t, w in zip((pair // max(1, len(items.starts))).tolist(), (pair % max(1, len(items.starts))).tolist(), strict=True):
        names[t].append(items.of[w])
    listed = [sorted({items.names[i] for i in np.unique(np.concatenate(own)).tolist()} - {None}) if own else [] for own in names]
    # Matches: whole short items as they are; the longest ones of places where a window begins.
    full = items.sizes[window] == items.window
    at = np.unique(place[full])
    length, suffix = shard.longest(at)
    short = np.flatnonzero(~full)
    lead = items.starts[window[short]]
    of_start = np.zeros(len(items.tokens), np.int64)
    of_start[items.order] = np.arange(len(items.order))
    goes_on = np.append(False, (at[1:] == at[:-1] + 1) & (length[1:] == length[:-1] - 1)) if len(at) else np.zeros(0, bool)
    at, length, suffix = (np.append(x[~goes_on], y) for x, y in ((at, place[short]), (length, items.sizes[window[short]]), (suffix, of_start[lead])))
    text = np.searchsorted(shard.ends, at)
    by = np.lexsort((at, text))
    found = pa.StructArray.from_arrays([pa.array([items.names[i] for i in items.owner[suffix[by]].tolist()], pa.string()), pa.array(items.at[suffix[by]]), pa.array((at - begins[text])[by] if len(at) else at), pa.array(length[by])], fields=list(_ARROW.field(1).type.value_type))
    offsets = np.searchsorted(text[by], np.arange(len(texts) + 1)).astype(np.int32)
    return pa.table([pa.array(shard.counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), found).cast(_ARROW.field(1).type), pa.array(listed, pa.list_(pa.string()))], schema=_ARROW)


def _searcher(items: Items, column: int, keep: list[str], hits_only: bool = False):
    """Rows with what they hit; of a pass behind the first only rows that hit something are told."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in common.shards(batches, column, SHARD_BYTES):
            hits = matches(common.utf8(shard.column(column)), items)
            out = pa.table([*(shard.column(c) for c in keep), *hits.columns], names=[*keep, *_ARROW.names])
            if hits_only:
                out = out.filter(pa.compute.greater(pa.compute.list_value_length(hits.column("__hit_items")), 0))
            yield from out.to_batches()

    return search


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in lists of bounded size; the driver holds one at a time."""
    block, size = [], 0
    for name, item in benchmark.select(item_id, text).toLocalIterator():
        item = (item or "").encode()
        if block and size + len(item) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((None if name is None else str(name), item))
        size += len(item) + 100
    yield block


def find(docs: DataFrame, benchmark: DataFrame, text="text", keep: list[str] | None = None, item_id="item_id", item_text="text", window: int = WINDOW) -> DataFrame:
    """docs (their columns in `keep`) with __hit_words (number of words), __hit_matches: the longest verbatim
    matches of a window or more, with an item, where they are in it and in the text, and words; and
    __hit_items: all items with windows that occur."""
    common.bounded_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    every = blocks(benchmark, item_id, item_text)
    block, following = next(every), next(every, None)
    if following is None:
        schema = T.StructType([docs.schema[c] for c in keep] + _KINDS.fields)
        return docs.mapInArrow(_searcher(Items(block, window), docs.columns.index(text), keep), schema)
    # A larger benchmark: rows get a key, each pass writes what it found by these keys, and the passes meet in the end.
    spark, row = docs.sparkSession, "__hit_row"
    keyed = common.cut(docs.withColumn(row, F.monotonically_increasing_id()), "keyed-documents")
    schema = T.StructType([T.StructField(row, T.LongType())] + _KINDS.fields)
    folder, first = common.shared_dir(spark, "benchmark-passes"), True
    while block is not None:
        found = keyed.select(row, text).mapInArrow(_searcher(Items(block, window), 1, [row], not first), schema)
        found.write.mode("append").parquet(folder)
        block, following, first = following, next(every, None), False
    names = [f.name for f in _KINDS.fields]
    passes = spark.read.schema(schema).parquet(folder).groupBy(F.col(row).alias("__hit_of"))
    merged = passes.agg(F.max(names[0]).alias(names[0]), *[F.flatten(F.collect_list(c)).alias(c) for c in names[1:]])
    return keyed.join(merged, F.col(row) == F.col("__hit_of")).select(*keep, *names)


def _n_hit():
    """Words in any match: matches overlap, so they are walked in order of their beginning."""
    spans = F.array_sort(F.transform("__hit_matches", lambda m: F.struct(m["at"].alias("b"), (m["at"] + m["n"]).alias("e"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["e"] - F.greatest(s["b"], a["e"]))).alias("n"), F.greatest(a["e"], s["e"]).alias("e"))
    return F.aggregate(spans, start, step, lambda a: a["n"])


def _contaminated(n_hit, n_words):
    return (n_hit > 0) & (n_hit * SHARE >= n_words)


def verdicts(found: DataFrame) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated from what find() adds."""
    items = F.array_sort(F.array_distinct("__hit_items"))
    return found.withColumns({
        "n_words": F.col("__hit_words"),
        "n_hit": _n_hit(),
        "n_items": F.size(items).cast("long"),
        "items_sha256": F.sha2(F.array_join(items, ",").cast("binary"), 256),
        "longest_match": F.coalesce(F.array_max(F.transform("__hit_matches", lambda m: m["n"])), F.lit(0).cast("long")),
    }).withColumn("contaminated", _contaminated(F.col("n_hit"), F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, text="text") -> DataFrame:
    """docs without the contaminated ones."""
    found = find(docs, benchmark, text)
    return found.filter(~_contaminated(_n_hit(), F.col("__hit_words"))).select(*docs.columns)


def op1(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document, by the contract of op1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return verdicts(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match")


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
offsets AS (
  SELECT item_id, least(13, len(w)) AS n, i AS j, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lengths WHERE len(w) >= n),
hits AS (
  SELECT doc_id, i, x.n, s, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM starts) x JOIN windows USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY encode(s)) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id),
spots AS (SELECT DISTINCT h.doc_id, h.i, o.item_id, o.j, h.n FROM hits h JOIN offsets o ON o.item_id = h.item_id AND o.n = h.n AND o.s = h.s),
runs AS (SELECT doc_id, max(n) + count(*) - 1 AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS g FROM spots) GROUP BY doc_id, item_id, i - j, g)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated,
       CAST(coalesce((SELECT max(m) FROM runs r WHERE r.doc_id = dw.doc_id), 0) AS BIGINT) AS longest_match
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

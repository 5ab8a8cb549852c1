"""Language identification by rank-order profiles of character n-grams.

A language's profile is the order of its most frequent n-grams (n up to 3, within words and over their
edges) in the texts that carry its label. A document's own most frequent n-grams are compared with each
profile: the out-of-place distance adds up how far each n-gram stands from its place there, and a fixed
penalty for those the profile lacks. The nearest profile names the language.

Profiles are learned from a bounded sample of the labelled rows: PER_LANGUAGE documents of each
language, about, chosen by a hash of their ids. Every document is scored whole.

Nulls: a null text, or one without letters, is `und` with score 0; a null or held-out label teaches
nothing. Equal distances go to the first label by name. Without any label everything is `und`. Empty
tables give empty results; repeated rows repeat their result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantia.llm import common

#: Documents that teach a language, about; n-grams of a profile and of a document.
PER_LANGUAGE, PROFILE = 1000, 300
#: Bytes of text at once, and characters of a text whose n-grams are counted at once.
SHARD_BYTES, PIECE = 2 << 20, 1 << 18
UNKNOWN = "und"

_NO_LETTERS = re.compile(r"[\W\d_]+")
#: Letters are what str.isalpha takes for them; \w also has numbers that \d lacks (½ ² ① Ⅷ). They are rare, so
#: texts are looked through for them by a table, and only those with some go through the larger pattern.
_NUMBERS = "".join(c for c in map(chr, range(0xA0, 0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
_MORE_NUMBERS = re.compile(rf"[{_NUMBERS} ]+")
_IS_NUMBER = np.zeros(0x110000, bool)
_IS_NUMBER[[ord(c) for c in _NUMBERS]] = True


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letters(text: str) -> str:
    """The words of a text, as runs of letters in lower case with a blank between."""
    words = _NO_LETTERS.sub(" ", text.lower()).strip()
    if not words.isascii() and _IS_NUMBER[_points(words)].any():
        words = _MORE_NUMBERS.sub(" ", words).strip()
    return words
_BITS = 21


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, as numbers, and their counts."""
    words = letters(text)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = f" {words} "
    found = [_grams(words[at : at + PIECE + 2], at + PIECE + 2 >= len(words)) for at in range(0, len(words) - 1, PIECE)]
    return found[0] if len(found) == 1 else summed(found)


def _grams(piece: str, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that begin in a piece; its last two characters belong to the next one, if there is one."""
    c = _points(piece).astype(np.int64)
    own = len(c) if last else len(c) - 2
    two = (c[:-1] << _BITS) | c[1:]
    three = (two[:-1] << _BITS) | c[2:]
    inner = c[1:-1] != 32  # no n-gram goes on behind a word's end
    return np.unique(np.concatenate([c[:own][c[:own] != 32], two[:own], three[inner]]), return_counts=True)


def summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    ids, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return ids, np.bincount(at, np.concatenate([f[1] for f in found]), len(ids)).astype(np.int64)


def top(ids: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The n most frequent, in order; equal counts by number."""
    if len(ids) > n:
        bound = np.partition(counts, len(counts) - n)[len(counts) - n]
        ids, counts = ids[counts >= bound], counts[counts >= bound]
    return ids[np.lexsort((ids, -counts))][:n]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, n-gram, count), summed over each shard."""
    for shard in common.shards(batches, 1, SHARD_BYTES):
        by: dict[str, list] = {}
        for lang, text in zip(shard.column(0).to_pylist(), shard.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(grams(text or ""))
        for lang, found in by.items():
            ids, counts = summed(found)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(ids), pa.string()), "gram": ids, "n": counts})


def profiles(docs: DataFrame, doc_id="doc_id", text="text", lang="lang", per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Each language's n-grams in order, learned from rows that are not held out."""
    taught = docs.filter(F.col(lang).isNotNull() & ~common.held_out(doc_id))
    sizes = taught.groupBy(F.col(lang).alias("__lang")).agg(F.count(F.lit(1)).alias("__n"))
    draw = F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) / (1 << 20)
    sample = taught.join(F.broadcast(sizes), F.col(lang) == F.col("__lang")).filter(draw * F.col("__n") < per_language)
    counts = sample.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(_count, "lang string, gram bigint, n bigint")
    ranked = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    out: dict[str, list] = {}
    for name, gram in ranked.filter(F.col("rank") <= PROFILE).orderBy("lang", "rank").select("lang", "gram").collect():
        out.setdefault(name, []).append(gram)
    return {name: np.array(g, np.int64) for name, g in sorted(out.items())}


class Classifier:
    def __init__(self, learned: dict[str, np.ndarray]):
        self.names = list(learned)
        self.orders = [np.argsort(p) for p in learned.values()]
        self.sorted = [p[o] for p, o in zip(learned.values(), self.orders, strict=True)]

    def predict(self, text: str) -> tuple[str, float]:
        """(language, score): the score is how much nearer the first profile is than the second."""
        own = top(*grams(text))
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        place = np.arange(len(own))
        far = []
        for known, order in zip(self.sorted, self.orders, strict=True):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            far.append(int(np.where(known[at] == own, np.minimum(np.abs(order[at] - place), PROFILE), PROFILE).sum()))
        best = int(np.argmin(far))
        others = sorted(far[:best] + far[best + 1 :])
        second = others[0] if others else PROFILE * len(own)
        return self.names[best], second / (far[best] + second) if far[best] + second else 1.0


def identify(docs: DataFrame, learned: dict[str, np.ndarray], doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    common.bounded_batches(docs.sparkSession)
    classifier = Classifier(learned)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in common.shards(batches, 2, SHARD_BYTES):
            found = [classifier.predict(t or "") for t in shard.column(2).to_pylist()]
            out = pa.table({"doc_id": shard.column(0), "held_out": shard.column(1), "lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64())})
            yield from out.to_batches()

    rows = docs.select(F.col(doc_id).alias("doc_id"), common.held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(score, f"doc_id {rows.schema[0].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def op7(spark, sf_dir: str) -> DataFrame:
    """The language of every document, by the contract of op7."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, profiles(docs))

"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing gives each token a fixed sparse random vector (its index vector, from a hash) and adds
the index vectors of its neighbours up into a context vector. A document is the mean of its tokens'
vectors. A network of one hidden layer and one output layer, in numpy, turns that into a probability of
label 1, calibrated by a temperature on sample rows kept aside.

Vectors and network are fitted on a bounded sample: SAMPLE labelled rows, the first by a hash of their
ids, without those held out. Tokens outside the VOCABULARY most frequent ones count as their shape
(case, digits, length, symbols), or as nothing if that is not among them either. Every document is
scored whole.

Nulls: a null or empty text has the mean of no tokens and is scored like any other; null labels and
labels other than 0 and 1 teach nothing; of several labels of one document the largest counts. Without
any label every score is 0.5. Empty tables give empty results, repeated rows repeat their result, and
no column but the text is an input.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm import common

#: Labelled rows that teach; tokens with vectors of their own; length, entries and reach of index vectors.
SAMPLE, VOCABULARY = 10_000, 8192
DIMENSIONS, ENTRIES, REACH = 48, 4, 2
HIDDEN, EPOCHS, RATE, SEED = 32, 40, 0.01, 11
#: A document is good from this probability on.
THRESHOLD = 0.7
#: Text that is pooled at once, and tokens that a task remembers (some 100 bytes each).
SHARD_BYTES, REMEMBERED = 2 << 20, 200_000

AGAIN = ("<again 1>", "<again 2>")
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def tokens(text: str) -> list[str]:
    """Words and runs of symbols; one that repeats the token just before, or the one before that, is
    told apart as a repetition."""
    found = _TOKEN.findall(text)
    again = [AGAIN[0] if t == a else AGAIN[1] if t == b else t for t, a, b in zip(found[2:], found[1:], found, strict=False)]
    return found[:2] + again


def shape(token: str) -> str:
    """What stands for a token that has no vector of its own."""
    c = token[0]
    if not (c.isalnum() or c == "_"):
        return f"<symbols {min(len(token), 4)}{c}>" if len(set(token)) == 1 and ord(c) < 128 else "<symbols>"
    kind = "digits" if token.isdigit() else "mixed" if any(map(str.isdigit, token)) else "upper" if token.isupper() else "title" if token.istitle() else "lower" if token.islower() else "other"
    return f"<{kind} {min(len(token) // 4, 4)}>"


def index_vector(token: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    rng = np.random.default_rng(zlib.crc32(token.encode("utf-8", "surrogatepass")))
    v = np.zeros(dimensions, np.float32)
    at = rng.choice(dimensions, ENTRIES, replace=False)
    v[at] = np.where(np.arange(ENTRIES) % 2, -1, 1)
    return v


class Numbers(dict):
    """Numbers of the tokens with vectors; others get the number of their shape, or the one behind the
    last, which stands for nothing. A task makes its own."""

    def __init__(self, names: list[str]):
        super().__init__({n: i for i, n in enumerate(names)})
        self.nothing, self.room = len(names), len(names) + REMEMBERED

    def __missing__(self, token: str) -> int:
        n = self.get(shape(token), self.nothing)
        if len(self) < self.room:
            self[token] = n
        return n


@dataclass
class Model:
    """`vectors` has a row for each name, and one of zeros behind them."""

    names: list[str]
    vectors: np.ndarray
    weights: dict = field(default_factory=dict)
    temperature: float = 1.0

    def pool(self, texts: list[str], numbers: Numbers) -> np.ndarray:
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        for i, text in enumerate(texts):
            found = tokens(text)
            if found:
                ids = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
                if len(ids) < 4 * len(self.vectors):
                    out[i] = self.vectors[ids].mean(0)
                else:
                    out[i] = np.bincount(ids, minlength=len(self.vectors)) @ self.vectors / len(ids)
        return out

    def logit(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        if not w:
            return np.zeros(len(x))
        return np.tanh((x - w["mean"]) / w["scale"] @ w["a"] + w["b"]) @ w["c"] + w["d"]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -500, 500)))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", label="quality", size: int = SAMPLE) -> DataFrame:
    """(label, text, place, mark) of the sample, written to the shared folder since it is read three times: of the
    first labelled ids by hash the rows, equal ones once, and of those the first by hash of id and of text."""
    known = labels.filter(F.col(label).isin(0, 1) & ~common.held_out(doc_id)).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(size)  # at most SAMPLE rows, so they can be broadcast
    rows = docs.join(F.broadcast(known), F.col(doc_id) == F.col("__id")).select("label", F.coalesce(text, F.lit("")).alias("text"), F.xxhash64("__id").alias("place"))
    once = rows.groupBy("label", "place", F.xxhash64("text").alias("mark")).agg(F.first("text").alias("text"))
    once = common.cut(once.select("label", "text", "place", "mark"), "quality-sample")
    # An id may have very many texts; their keys say where the sample ends.
    key = F.struct("place", "mark", "label")
    last = once.select(key.alias("key")).orderBy("key").limit(size).agg(F.max("key").alias("key")).first()["key"]
    return once if last is None else once.filter(key <= F.struct(*[F.lit(v).cast(once.schema[c].dataType).alias(c) for c, v in last.asDict().items()]))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in common.shards(batches, 1, SHARD_BYTES):
        c: Counter = Counter()
        for t in shard.column(1).to_pylist():
            found = tokens(t)
            c.update(found)
            c.update(map(shape, found))
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(c), pa.string()), "n": pa.array(list(c.values()), pa.int64())})


def _contexts(names: list[str]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, index = Numbers(names), np.array([index_vector(n) for n in names] + [np.zeros(DIMENSIONS, np.float32)])
        total, end = np.zeros((len(names) + 1, DIMENSIONS)), len(names)
        for shard in common.shards(batches, 1, SHARD_BYTES):
            ids = np.array([i for t in shard.column(1).to_pylist() for i in (*map(numbers.__getitem__, tokens(t)), *[end] * REACH)], np.int64)
            for step in range(1, REACH + 1):
                for here, there in ((ids[:-step], ids[step:]), (ids[step:], ids[:-step])):
                    for d in range(DIMENSIONS):
                        total[:, d] += np.bincount(here, index[there, d], len(names) + 1)
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(names)), "v": pa.array(list(total[:-1]), pa.list_(pa.float64()))})

    return task


def fit(docs: DataFrame, labels: DataFrame, **columns) -> Model:
    """The model, from the labelled sample. The driver sees VOCABULARY vectors and SAMPLE pooled rows."""
    common.bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, **columns)
    counts = sample.select("label", "text").mapInArrow(_counts, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    names = [r.token for r in counts.orderBy(F.desc("n"), "token").limit(VOCABULARY).collect()]
    model = Model(names, np.zeros((len(names) + 1, DIMENSIONS), np.float32))
    if not names:
        return model
    sums = sample.select("label", "text").coalesce(16).mapInArrow(_contexts(names), "at bigint, v array<double>").groupBy("at").agg(F.array(*[F.sum(F.col("v")[d]) for d in range(DIMENSIONS)]).alias("v"))
    context = np.zeros((len(names), DIMENSIONS))
    for r in sums.collect():
        context[r.at] = r.v
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    model.vectors[:-1] = unit(context - context.mean(0)) + unit(np.array([index_vector(n) for n in names]))

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(model.names)
        for shard in common.shards(batches, 3, SHARD_BYTES):
            x = model.pool(shard.column(3).to_pylist(), numbers)
            yield from pa.table([*(shard.column(k) for k in range(3)), pa.array(list(x), pa.list_(pa.float32()))], names=["label", "place", "mark", "x"]).to_batches()

    rows = sorted(sample.select("label", "place", "mark", "text").mapInArrow(pooled, "label int, place bigint, mark bigint, x array<float>").collect(), key=lambda r: (r.place, r.mark, r.label))
    train(model, np.array([r.x for r in rows]).reshape(-1, DIMENSIONS), np.array([r.label for r in rows], float))
    return model


def train(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Fit the two layers on four fifths of the rows, the temperature on the rest."""
    if not len(y):
        return
    rng = np.random.default_rng(SEED)
    cut = max(1, len(y) * 4 // 5)
    w = {"mean": x[:cut].mean(0), "scale": x[:cut].std(0) + 1e-3, "a": rng.normal(0, DIMENSIONS**-0.5, (DIMENSIONS, HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(())}
    z, t = (x[:cut] - w["mean"]) / w["scale"], y[:cut]
    m = {k: [np.zeros_like(w[k]), np.zeros_like(w[k])] for k in "abcd"}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(cut)
        for i in range(0, cut, 128):
            zi, ti = z[order[i : i + 128]], t[order[i : i + 128]]
            h = np.tanh(zi @ w["a"] + w["b"])
            d = (1 / (1 + np.exp(-(h @ w["c"] + w["d"]))) - ti) / len(ti)
            dh = np.outer(d, w["c"]) * (1 - h * h)
            g = {"a": zi.T @ dh + 1e-4 * w["a"], "b": dh.sum(0), "c": h.T @ d + 1e-4 * w["c"], "d": d.sum()}
            step += 1
            for k, grad in g.items():
                m[k] = [0.9 * m[k][0] + 0.1 * grad, 0.999 * m[k][1] + 0.001 * grad * grad]
                w[k] = w[k] - RATE * 0.93**epoch * (m[k][0] / (1 - 0.9**step)) / (np.sqrt(m[k][1] / (1 - 0.999**step)) + 1e-8)
    model.weights = w
    aside, truth = (x[cut:], y[cut:]) if cut < len(y) else (x, y)
    logit = model.logit(aside)
    loss = lambda s: np.mean(np.logaddexp(0, -(2 * truth - 1) * logit / s))
    model.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))


def classify(docs: DataFrame, model: Model, text="text") -> DataFrame:
    """docs with __score (probability of label 1)."""
    common.bounded_batches(docs.sparkSession)
    column, names = docs.columns.index(text), docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(model.names)
        for shard in common.shards(batches, column, SHARD_BYTES):
            chance = model.score(model.pool([t or "" for t in shard.column(column).to_pylist()], numbers))
            yield from pa.table([*shard.columns, pa.array(chance, pa.float64())], names=[*names, "__score"]).to_batches()

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())]))


def accepted(docs: DataFrame, model: Model, text="text") -> DataFrame:
    """docs without those that the model rejects."""
    return classify(docs, model, text).filter(F.col("__score") >= THRESHOLD).select(*docs.columns)


def op2(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, by the contract of op2."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = classify(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text"), labels))
    return scored.select("doc_id", common.held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))

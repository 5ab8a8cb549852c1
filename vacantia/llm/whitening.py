"""Embedding whitening by matrix-free block subspace iteration.

The covariance of the fit list (each distinct vector once) is never formed: each Spark pass computes
X'(XQ) over centred rows X for a block Q of orthonormal columns. The driver makes Q'VQ of it, whose
eigenvectors give the best approximations within the block (Rayleigh-Ritz) together with their residuals
|Vu - eu|, which the same pass already holds. Passes end when the residuals of all wanted components are
as small as rounding; the next block is the orthonormalised product (QR). A block whose last value is too
close to the wanted ones to converge soon is widened, in the end to the whole space, where one pass is exact.

Vectors are whole numbers, so their sums and distances are exact, and centring loses nothing. A component
that holds (nearly) no variance can't be scaled to one and is left out: fewer distinct vectors than
components give fewer. Every array is bounded by dimensions times block; partial products meet in Spark,
by row of the product and in a fixed order, so reruns agree.

Vectors that are null, hold null or non-finite entries, or entries beyond 2**46 take no part. All vectors
of one table should have one length; of several lengths the most frequent is whitened (the shortest of
equally frequent ones) and other rows take no part. Null ids stay null, repeated rows and ids are whitened
each, vectors without entries have no components. An empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm import common

COMPONENTS = 16
#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Residuals, relative to the first value, that certify a component; values, likewise, that hold no variance.
RESIDUAL, NOTHING = 1e-12, 1e-11
#: Passes that a block may still need before it is widened, and that are made at most.
SOON, PASSES = 12, 200

_LARGEST = float(1 << 46)
_SUMS = "i int, part int, sums binary"


@dataclass(frozen=True)
class Model:
    n: int  # vectors of the fit list
    sums: tuple[int, ...]  # by dimension, exact
    components: np.ndarray  # d x k, unit columns
    values: np.ndarray  # falling
    trace: float
    residuals: np.ndarray
    passes: int
    identity_error: float


def whole(vectors: DataFrame, vec_id="vec_id", vector="embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id, x): the vectors that take part, as whole numbers."""
    v = F.col(vector)
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _LARGEST)
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(offset).cast("long"))
    return vectors.filter(v.isNotNull() & F.forall(v, fine)).select(F.col(vec_id).cast("long").alias("id"), x.alias("x"))


def _matrix(batch: pa.RecordBatch, column: int, d: int) -> tuple[np.ndarray, pa.RecordBatch]:
    """The vectors of d entries, and their rows."""
    rows = batch.filter(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(batch.column(column)), d), False))
    return rows.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d), rows


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exactly: as 64-bit numbers where none can leave them, else as Python's."""
    largest = max(int(np.abs(x).max(initial=0)) * n, max((abs(int(s)) for s in sums), default=0))
    return n * x - sums.astype(np.int64) if largest < 1 << 61 else n * x.astype(object) - sums


def squares(deviation: np.ndarray) -> list[int | None]:
    """Sums of squares by row, exactly; None where they are no 64-bit number."""
    largest = max((abs(int(v)) for v in (deviation.min(initial=0), deviation.max(initial=0))), default=0)
    if largest * largest * max(1, deviation.shape[1]) >= 1 << 63:
        deviation = deviation.astype(object)
    return [s if s < 1 << 63 else None for s in (int(v) for v in (deviation * deviation).sum(1))]


def _summed(kind: str):
    """Sums of the partial ones of each row i, in the order of the tasks that made them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if at is not None and i != at:
                    yield pa.RecordBatch.from_pydict({"i": pa.array([at], pa.int32()), "part": pa.array([0], pa.int32()), "sums": [total.tobytes()]})
                    total = None
                part = np.frombuffer(data, kind)
                at, total = i, part.copy() if total is None else total + part
        if at is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array([at], pa.int32()), "part": pa.array([0], pa.int32()), "sums": [total.tobytes()]})

    return task


def _reduced(vectors: DataFrame, task, kind: str) -> dict[int, np.ndarray]:
    """Rows of the sum over all tasks; the driver gets one of each i."""
    parts = vectors.select("x").mapInArrow(task, _SUMS).repartition("i").sortWithinPartitions("i", "part")
    return {i: np.frombuffer(data, kind) for i, _, data in parts.mapInArrow(_summed(kind), _SUMS).collect()}


def _emitted(rows: dict[int, np.ndarray]) -> pa.RecordBatch:
    part = pa.array([TaskContext.get().partitionId()] * len(rows), pa.int32())
    return pa.RecordBatch.from_pydict({"i": pa.array(list(rows), pa.int32()), "part": part, "sums": pa.array([v.tobytes() for v in rows.values()], pa.binary())})


#: Limbs of an exact sum: each holds so many bits, so that 2**37 values add up within 64 bits.
_LIMB = 26


def _sums(d: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x, _ = _matrix(batch, 0, d)
            n, low, high = n + len(x), low + (x & ((1 << _LIMB) - 1)).sum(0), high + (x >> _LIMB).sum(0)
        yield _emitted({0: np.array([n], np.int64), 1: low, 2: high})

    return task


def _product(d: int, n: int, sums: np.ndarray, q: np.ndarray):
    """Rows of X'(XQ), and as row d the sum of all squares of X, for the rows X = x - sums / n."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squared = np.zeros((d, q.shape[1])), 0.0
        for batch in batches:
            x = (deviations(_matrix(batch, 0, d)[0], n, sums) / n).astype(np.float64)
            total += x.T @ (x @ q)
            squared += float((x * x).sum())
        yield _emitted({**{i: total[i] for i in range(d)}, d: np.array([squared])})

    return task


def _whitened_sums(d: int, n: int, sums: np.ndarray, scaled: np.ndarray):
    """Sums and products of whitened rows: row 0 has the sums, row i + 1 those with component i."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = scaled.shape[1]
        total, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = (deviations(_matrix(batch, 0, d)[0], n, sums) / n).astype(np.float64) @ scaled
            total, first = total + w.T @ w, first + w.sum(0)
        yield _emitted({0: first, **{i + 1: total[i] for i in range(k)}})

    return task


def _passes_left(values: np.ndarray, residuals: np.ndarray, k: int) -> float:
    """About how many passes the block still needs: errors fall as its last value to the k-th."""
    rate = values[-1] / values[k - 1] if values[k - 1] > 0 else 0.0
    missing = np.log(max(residuals[:k].max(), 1e-300) / (RESIDUAL * values[0]))
    return missing / -np.log(rate) if 0 < rate < 1 else (0.0 if rate <= 0 else np.inf)


def fit(vectors: DataFrame, k: int = COMPONENTS, seed: int = 20240607) -> Model | None:
    """The k first components of the distinct vectors among `vectors` (id, x); None if there are none."""
    spark = vectors.sparkSession
    common.bounded_batches(spark)
    lengths = vectors.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("m"), "d").first()
    if lengths is None:
        return None
    d = lengths[0]
    each = common.cut(vectors.filter(F.size("x") == d).select("x").distinct(), "fit-list")
    found = _reduced(each, _sums(d), "int64")
    n = int(found[0][0])
    sums = np.array([int(lo) + (int(hi) << _LIMB) for lo, hi in zip(found[1], found[2], strict=True)], object)
    rng, k = np.random.default_rng(seed), min(k, d)
    if not k:
        return Model(n, (), np.zeros((0, 0)), np.zeros(0), 0.0, np.zeros(0), 0, 0.0)
    q = np.linalg.qr(rng.standard_normal((d, min(d, 2 * k))))[0]
    for passes in range(1, PASSES + 1):
        rows = _reduced(each, _product(d, n, sums, q), "float64")
        y = np.stack([rows[i] for i in range(d)]) / n
        h = q.T @ y
        values, inner = np.linalg.eigh((h + h.T) / 2)
        values, inner = values[::-1], inner[:, ::-1]
        y, u = y @ inner, q @ inner
        residuals = np.linalg.norm(y - u * values, axis=0)
        if residuals[:k].max() <= RESIDUAL * max(values[0], 0):
            break
        # A product of no length has no direction of its own; QR then takes any that is left.
        wider = min(d, 2 * q.shape[1]) - q.shape[1] if passes > 1 and _passes_left(values, residuals, k) > SOON else 0
        q = np.linalg.qr(np.hstack([y, rng.standard_normal((d, wider)) * max(values[0], 1)]))[0]
    else:
        raise ArithmeticError(f"residuals {residuals[:k].max():g} of {values[0]:g} after {PASSES} passes")
    trace = float(rows[d][0]) / n
    keep = np.flatnonzero(values[:k] > NOTHING * max(values[0], 0))
    u, values = u[:, keep] / np.linalg.norm(u[:, keep], axis=0), values[keep]
    error = 0.0
    if len(keep):
        rows = _reduced(each, _whitened_sums(d, n, sums, u / np.sqrt(values)), "float64")
        mean = rows[0] / n
        error = float(np.abs(np.stack([rows[i + 1] for i in range(len(keep))]) / n - np.outer(mean, mean) - np.eye(len(keep))).max())
    return Model(n, tuple(int(s) for s in sums), u, values, trace, residuals[keep], passes, error)


def whiten(vectors: DataFrame, model: Model) -> DataFrame:
    """(id, deviation, whitened) of each row of `vectors` (id, x) that has the model's length: the sum of
    (n * x - sums)**2, exact (null if it is no 64-bit number), and the row's components, each of variance one."""
    common.bounded_batches(vectors.sparkSession)
    d, n, sums = len(model.sums), model.n, np.array(model.sums, object)
    scaled = model.components / np.sqrt(model.values)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = _matrix(batch, 1, d)
            if not len(x):
                continue
            from_mean = deviations(x, n, sums)
            whitened = (from_mean / n).astype(np.float64) @ scaled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * scaled.shape[1], pa.int32()), pa.array(whitened.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(squares(from_mean), pa.int64()), lists], names=["id", "deviation", "whitened"])

    return vectors.select("id", "x").mapInArrow(task, "id bigint, deviation bigint, whitened array<double>")


def op12(spark, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every row, by the contract of op12."""
    vectors = whole(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    model = fit(vectors)
    if model is None or not len(model.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    each = whiten(vectors, model).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )

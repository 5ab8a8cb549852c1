"""Helpers shared by the corpus operators: shared folders, batches of bounded size, fixed hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) mod HELD_OUT_MOD is HELD_OUT are never learned from.
HELD_OUT_MOD, HELD_OUT = 4, 2


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share, below spark.checkpoint.dir.

    Only a local session that names no such folder (tests) falls back to a local temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which a query's shuffle files go as soon as the query has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Write df below the shared folder and read it again: lost executors don't undo it, and the
    shuffle files that led to it are not needed any more. Settings hold while it is written."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    settings = {_CLEAN: "true", **(settings or {})}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Keep the Arrow batches that go to Python workers small even where texts are long. The setting is read
    when a plan runs, which may be long after this call, so it stays set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def held_out(doc_id="doc_id"):
    """Column: the row belongs to the fold that no label may be learned from (null ids: they don't)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_MOD == HELD_OUT, F.lit(False))


def shards(batches: Iterable[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.Table]:
    """Whole rows in tables that hold about `limit` bytes of the given string or binary column.

    A single longer row makes a table of its own. Nothing is dropped, cut or reordered. What Arrow keeps
    of freed tables goes back to the system behind each one, as workers live on from stage to stage.
    """
    pool = pa.default_memory_pool()
    waiting: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        begin = 0
        for at, n in enumerate(lengths):
            if total and total + n > limit:
                if at > begin:
                    waiting.append(batch.slice(begin, at - begin))
                yield pa.Table.from_batches(waiting)
                waiting, total, begin = [], 0, at
                pool.release_unused()
            total += n + 1
        if len(lengths) > begin:
            waiting.append(batch.slice(begin))
    if waiting:
        yield pa.Table.from_batches(waiting)
    pool.release_unused()


def utf8(column: pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return pa.compute.fill_null(column.cast(pa.binary()), b"").to_pylist()

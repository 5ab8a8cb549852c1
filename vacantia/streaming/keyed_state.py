"""State that survives restarts: a table in buckets of its keys, of which a batch rewrites only those it touches.

Rows lie in folders by version and bucket (a hash of the keys), which are written once and never changed.
A commit is one row of a log, written when its version's files are complete: which buckets the version
has, and which stream and batch it came from. The current table is, of each bucket, the last version in
the log. So what a lost driver leaves half written is never read; a batch that a restarted stream hands
over again is written anew if it was not committed, and skipped if it was.

The number of buckets is fixed with the first commit: a batch of n keys reads and rewrites n / buckets of
the table at most, and a bucket should fit a task. What the driver holds is one number per bucket.
Folders of replaced versions stay until the folder's owner clears them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_VERSION, _BUCKET = "state_version", "state_bucket"
_LOG = "version int, stream string, batch bigint, n_buckets int, buckets array<int>, emptied array<int>, at timestamp"


class KeyedState:
    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str], n_buckets: int = 256):
        self.spark, self.folder, self.schema, self.keys, self.n_buckets = spark, folder.rstrip("/"), schema, keys, n_buckets
        if (known := self._log().agg(F.max("n_buckets")).first()[0]) not in (None, n_buckets):
            raise ValueError(f"{folder} has {known} buckets, not {n_buckets}")

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(_LOG).parquet(f"{self.folder}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _LOG)

    @property
    def version(self) -> int:
        """The last version; -1 for a table that has none."""
        last = self._log().agg(F.max("version")).first()[0]
        return -1 if last is None else last

    def committed(self, stream: str, batch: int) -> int | None:
        """The version that a stream's batch has become, if it has."""
        return self._log().filter((F.col("stream") == stream) & (F.col("batch") == batch)).agg(F.max("version")).first()[0]

    def _current(self, version: int | None = None) -> dict[int, int]:
        """The version of each bucket that has rows, now or as of a version."""
        log = self._log() if version is None else self._log().filter(F.col("version") <= version)
        each = log.select("version", F.explode(F.concat("buckets", "emptied")).alias("bucket"), F.col("emptied"))
        last = each.groupBy("bucket").agg(F.max_by(F.struct("version", F.array_contains("emptied", F.col("bucket")).alias("gone")), "version").alias("l"))
        return {r[0]: r[1] for r in last.filter(~F.col("l.gone")).select("bucket", "l.version").collect()}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n_buckets)).cast("int")

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The table, or some of its buckets: only their files are listed and read."""
        current = self._current(version)
        wanted = current if buckets is None else {b: current[b] for b in buckets if b in current}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.folder}/rows/{_VERSION}={v}/{_BUCKET}={b}" for b, v in sorted(wanted.items())]
        return self.spark.read.schema(self.schema).option("basePath", f"{self.folder}/rows").parquet(*paths).select(*self.schema.names)

    def touched(self, incoming: DataFrame) -> list[int]:
        return sorted(r[0] for r in incoming.select(self.bucket().alias("b")).distinct().collect())

    def merge(self, incoming: DataFrame, rule: Callable[[DataFrame, DataFrame], DataFrame], stream: str = "start", batch: int = 0) -> int:
        """rule(stored rows of the buckets that incoming touches, incoming) becomes their next version, whose
        number is returned. A stream's batch is merged once, however often it is handed over. incoming must
        have the table's keys, and a rule must not move a row to other keys than the batch's or its own."""
        done = self.committed(stream, batch)
        if done is not None:
            return done
        number, touched = self.version + 1, self.touched(incoming)
        path = f"{self.folder}/rows/{_VERSION}={number}"
        held: list[int] = []
        if touched:
            new = rule(self.read(touched), incoming).select(*self.schema.names)
            new.withColumn(_BUCKET, self.bucket()).repartition(len(touched), _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(path)
            try:
                held = sorted(r[0] for r in self.spark.read.option("basePath", path).parquet(path).select(_BUCKET).distinct().collect())
            except AnalysisException as error:  # no row is left
                if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                    raise
        if not {*held} <= {*touched}:
            raise ValueError("a rule moved rows to buckets that its batch does not touch")
        row = self.spark.createDataFrame([(number, stream, batch, self.n_buckets, held, [b for b in touched if b not in held], None)], _LOG)
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return number


def later(old: DataFrame, incoming: DataFrame) -> DataFrame:
    """A rule for cursors (board, since): the later moment stands."""
    return old.unionByName(incoming).groupBy("board").agg(F.max("since").alias("since"))


CURSORS = "board string, since timestamp_ntz"


def ingest_stream(spark: SparkSession, landed: str, schema: StructType, state: KeyedState, rule: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, cursors: KeyedState | None = None, board: str = "source", changed: str = "last_seen_at", error: str | None = None, files: int = 1) -> int:
    """Merge a folder's Parquet files into a state, `files` at a time, and return its last version. Started
    again with its checkpoint, the stream goes on where it stood; batches that it repeats change nothing.

    With cursors (keyed by `board`), rows of a board that changed before its cursor are passed over (those
    without a time never are), and the cursor moves to the latest change of a batch once that is committed,
    unless the batch holds an error of that board (a column that is NULL where there is none).
    """

    def step(batch: DataFrame, number: int) -> None:
        # The query's id lives in its checkpoint: the same after a restart, another for another stream.
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        batch = batch.persist()
        failed = batch.filter(F.col(error).isNotNull()).select(F.col(board).alias("board")).distinct() if error else None
        rows = batch.filter(F.col(error).isNull()) if error else batch
        fresh = rows
        if cursors is not None:
            boards = rows.select(F.col(board).alias("board")).distinct()
            known = cursors.read(cursors.touched(boards)).select(F.col("board").alias("__board"), "since")
            fresh = rows.join(known, F.col(board) == F.col("__board"), "left").filter(F.col("since").isNull() | F.col(changed).isNull() | (F.col(changed) >= F.col("since"))).drop("__board", "since")
        state.merge(fresh, rule, stream, number)
        if cursors is not None:
            moved = rows.filter(F.col(changed).isNotNull()).groupBy(F.col(board).alias("board")).agg(F.max(changed).cast("timestamp_ntz").alias("since"))
            cursors.merge(moved if failed is None else moved.join(failed, "board", "left_anti"), later, stream, number)
        batch.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(landed)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return state.version

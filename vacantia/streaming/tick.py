"""Windows of a stream of events, and the folder that ticks share. The stream of postings is keyed_state's."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; a local session that names none has a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def daily_windows(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", delay: str | None = None) -> DataFrame:
    """Counts and means per day and kind. A stream names a delay after which a day is final."""
    rows = events.withWatermark(time, delay) if delay else events
    out = rows.groupBy(F.window(time, "1 day").alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return out.select(F.to_date("w.start").alias("day"), "kind", "n", "mean")

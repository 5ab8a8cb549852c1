"""Zip archives as rows: their members' texts, in batches of bounded size.

    members(spark.read.format("binaryFile").load(folder), suffix=".md")
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of members' texts in a batch, and of the largest member that is read.
BATCH_BYTES, LARGEST = 4 << 20, 64 << 20


def members(archives: DataFrame, content: str = "content", path: str | None = "path", suffix: str = "", largest: int = LARGEST) -> DataFrame:
    """(archive, member, value, error) of the files in archives whose names have a suffix. An archive that can't be
    read, a damaged member and one of more than `largest` bytes (as a zip bomb has) are one row each with an error
    and no text; NULL archives are none. Members are unpacked one after the other."""
    rows = archives.select((F.col(path) if path and path in archives.columns else F.lit(None)).cast("string").alias("archive"), F.col(content).alias("content"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                if data is not None:
                    yield from _packed(batch.column(0)[i].as_py(), data, suffix, largest)

    return rows.mapInArrow(task, "archive string, member string, value string, error string")


def _packed(archive: str | None, data: bytes, suffix: str, largest: int) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple] = []
    size = 0
    for row in _texts(archive, data, suffix, largest):
        waiting.append(row)
        size += len(row[2] or "")
        if size > BATCH_BYTES:
            yield _batch(waiting)
            waiting, size = [], 0
    if waiting:
        yield _batch(waiting)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows, strict=True)], names=["archive", "member", "value", "error"])


def _texts(archive: str | None, data: bytes, suffix: str, largest: int) -> Iterator[tuple]:
    try:
        opened = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        yield archive, None, None, "no zip"
        return
    with opened:
        for entry in opened.infolist():
            if entry.is_dir() or not entry.filename.endswith(suffix):
                continue
            try:
                with opened.open(entry) as member:
                    text = member.read(largest + 1)  # what a header says of a size is not believed
                yield (archive, entry.filename, None, "too large") if len(text) > largest else (archive, entry.filename, text.decode("utf-8", "replace"), None)
            except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError) as error:
                yield archive, entry.filename, None, type(error).__name__


def zipped(files: DataFrame, name: str, value: str, group: Column) -> DataFrame:
    """(path, content): a zip archive of each group's files, names in order."""
    rows = files.select(group.cast("string").alias("path"), F.col(name).alias("name"), F.col(value).alias("value"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for member, text in sorted(zip(part["name"], part["value"], strict=True)):
                archive.writestr(member, text)
        return pd.DataFrame({"path": [part["path"].iloc[0]], "content": [out.getvalue()]})

    return rows.groupBy("path").applyInPandas(pack, "path string, content binary")

"""Landed responses of job boards as a data source, in batches and as a stream.

    spark.dataSource.register(landed.LandedResponses)
    spark.read.format("board_responses").load(folder)
    spark.readStream.format("board_responses").load(folder)

A fetcher lands each HTTP response as one line of JSON in a file of the folder: provider, slug, kind (`list`
or `detail`), page, key (of a detail), status, network_failed, body. The source gives a row for each
posting of a list page and for each detail, and one with an error code for a response that failed or
holds no such list. Files are read line by line, each in one task; the stream's offset is the name of
the last file, so files must land under rising names, and one file is never changed.

`postings` brings summaries and details together; a missing detail leaves the summary.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "provider string, slug string, kind string, page int, key string, payload string, error string, file string"
#: Where a provider's list stands in a response (the response itself, if nowhere), and the key of a posting. Fixed values.
LISTS = {"greenhouse": "jobs", "lever": None, "workable": "results", "ashby": "jobs", "smartrecruiters": "content", "recruitee": "offers", "teamtailor": "data", "traffit": None, "jobadder": "items", "breezy": None}
KEYS = {"workable": "shortcode", "jobadder": "adId", "breezy": "_id"}
#: Providers whose detail is laid over the summary; of the others it takes its place. Fixed values.
LAID_OVER = ("smartrecruiters",)
#: Bytes of files that one task reads, and rows of a batch.
SPLIT_BYTES, BATCH_ROWS = 64 << 20, 1000

_FIELDS = ("provider", "slug", "kind", "page", "key", "payload", "error", "file")
_ARROW = pa.schema([(f, pa.int32() if f == "page" else pa.string()) for f in _FIELDS])


def _code(response: dict) -> str | None:
    """A failed response's code: a lost connection, an unknown board, anything else."""
    status = response.get("status")
    if response.get("network_failed"):
        return "fetch_network_failed"
    if status == 404:
        return "invalid_ats_slug"
    return "fetch_failed" if status is None or status >= 400 else None


def _with_included(item: dict, included: list) -> dict:
    """A JSON:API entry with the entries that it points at."""
    ids = set()
    for relation in (item.get("relationships") or {}).values():
        data = (relation or {}).get("data") or []
        ids |= {(d.get("type"), d.get("id")) for d in (data if isinstance(data, list) else [data])}
    loose = {i for kind, i in ids if kind is None}
    return item | {"included": [e for e in included if (e.get("type"), e.get("id")) in ids or e.get("id") in loose]}


def rows_of(line: str, file: str) -> Iterator[tuple]:
    """The rows of one landed response."""
    try:
        response = json.loads(line)
        provider, slug, kind, page, key = (response.get(k) for k in ("provider", "slug", "kind", "page", "key"))
    except (ValueError, AttributeError):
        yield None, None, "error", None, None, None, "fetch_failed", file
        return
    head = (provider, slug)
    error = _code(response)
    if error is None:
        try:
            body = json.loads(response.get("body") or "")
            if kind == "detail":
                if not isinstance(body, dict):
                    raise ValueError(body)
                yield *head, "detail", page, None if key is None else str(key), json.dumps(body), None, file
                return
            place = LISTS[provider]
            items = body if place is None else body.get(place, [])
            if not isinstance(items, list):
                raise ValueError(items)
            for item in items:
                if provider == "teamtailor":
                    item = _with_included(item, body.get("included") or [])
                own = item.get(KEYS.get(provider, "id"))
                yield *head, "list", page, None if own is None else str(own), json.dumps(item), None, file
            return
        except (ValueError, KeyError, AttributeError, TypeError):
            error = "fetch_failed"
    # A lost detail is no failure of its board: the summary stands.
    yield *head, "error" if kind != "detail" else "missing", page, None if key is None else str(key), None, error, file


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _listed(folder: str) -> list[tuple[str, int]]:
    """Landed files by name, with their sizes; those a writer still hides are left out."""
    from pyarrow import fs

    system, path = _filesystem(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def _splits(files: list[tuple[str, int]]) -> list[_Files]:
    out: list[list[str]] = []
    size = SPLIT_BYTES
    for name, n in files:
        if size + n > SPLIT_BYTES:
            out.append([])
            size = 0
        out[-1].append(name)
        size += n
    return [_Files(names) for names in out]


def _lines(stream) -> Iterator[bytes]:
    """A file's lines; a long one is put together once, however many reads it takes."""
    pieces: list[bytes] = []
    while chunk := stream.read(1 << 20):
        first, *more = chunk.split(b"\n")
        pieces.append(first)
        if more:
            yield b"".join(pieces)
            yield from more[:-1]
            pieces = [more[-1]]
    yield b"".join(pieces)


def _read(folder: str, partition: _Files) -> Iterator[pa.RecordBatch]:
    system, path = _filesystem(folder)
    waiting: list[tuple] = []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*waiting, strict=True), _ARROW, strict=True)], schema=_ARROW)
    for name in partition.files:
        with system.open_input_stream(f"{path}/{name}") as stream:
            for line in filter(bytes.strip, _lines(stream)):
                # A response of many postings goes on in several batches.
                for row in rows_of(line.decode("utf-8", "replace"), name):
                    waiting.append(row)
                    if len(waiting) >= BATCH_ROWS:
                        yield batch()
                        waiting = []
    if waiting:
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        return _splits(_listed(self.folder)) or [_Files([])]

    def read(self, partition):
        return _read(self.folder, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self):
        return {"last": ""}

    def latestOffset(self):
        files = _listed(self.folder)
        return {"last": files[-1][0] if files else ""}

    def partitions(self, start, end):
        return _splits([f for f in _listed(self.folder) if start["last"] < f[0] <= end["last"]])

    def read(self, partition):
        return _read(self.folder, partition)

    def commit(self, end):
        """Files stay where they are; the offset says which are read."""


class LandedResponses(DataSource):
    @classmethod
    def name(cls):
        return "board_responses"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def streamReader(self, schema):
        return _Stream(self.options["path"])


def postings(landed: DataFrame) -> DataFrame:
    """(provider, slug, payload) of every listed posting with its detail, where there is one (of several the one
    that landed last). A posting that stands on two pages is one; postings without a key stand alone."""
    last = F.max_by("payload", F.struct("file", "page")).alias("payload")
    listed = landed.filter("kind = 'list' AND key IS NOT NULL").groupBy("provider", "slug", "key").agg(last)
    details = landed.filter("kind = 'detail' AND key IS NOT NULL").groupBy("provider", "slug", "key").agg(last).withColumnRenamed("payload", "__detail")
    both = listed.join(details, ["provider", "slug", "key"], "left")
    parts = lambda c: F.try_parse_json(c).cast("map<string,variant>")
    kept = F.map_filter(parts(F.col("payload")), lambda k, v: ~F.array_contains(F.map_keys(parts(F.col("__detail"))), k))
    laid = F.to_json(F.map_concat(kept, parts(F.col("__detail"))))
    payload = F.when(F.col("__detail").isNull(), F.col("payload")).when(F.col("provider").isin(*LAID_OVER), laid).otherwise(F.col("__detail"))
    alone = landed.filter("kind = 'list' AND key IS NULL").select("provider", "slug", "payload")
    return both.select("provider", "slug", payload.alias("payload")).union(alone)


def board_outcomes(landed: DataFrame) -> DataFrame:
    """Per board: pages and postings that came, details that are missing, and the first error's code (NULL if none)."""
    failed = F.when(F.col("kind") == "error", F.struct("file", "page"))
    return landed.groupBy("provider", "slug").agg(
        F.count_distinct(F.when(F.col("kind") == "list", F.col("page"))).alias("pages"), F.count_if(F.col("kind") == "list").alias("listed"),
        F.count_if(F.col("kind") == "missing").alias("missing"), F.min_by("error", failed).alias("error"),
    )

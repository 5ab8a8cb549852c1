"""Token ids in Arrow files of equal-length sequences.

A shard is one file of the Arrow IPC file format: record batches of fixed-size lists, `ids` (16 or 32
bits a token) and `mask` (one bit a token: 1 is a token, 0 is padding behind the shard's last token).
All batches but the last hold the same number of sequences, so sequence k is found by arithmetic and,
on a local or mounted store, read without a copy through a memory map. Beside it stands an index file,
in the same format, with each document's id, first token within the shard and number of tokens.

Documents are range-partitioned by id, so that shard after shard is ascending; each task tokenises its
own range and writes it under a name that its contents determine, first aside and then moved into
place, so a task that runs again replaces what it wrote.

Nulls: a null text is empty, a null id comes first. An empty text still has its end token. Repeated
ids stand in the order of a hash of their texts. An empty table gives no shard. Other columns are not read.
"""

from __future__ import annotations

import functools
import os
import math
import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantia.llm import common

#: Tokens of a sequence, sequences of a record batch, id behind each document.
SEQUENCE, BATCH, END = 2048, 64, 2
#: Bytes of text that are tokenised at once, and words whose ids a worker remembers (some 230 bytes each;
#: none longer than LONG), twice at most.
SHARD_BYTES, REMEMBERED, LONG = 2 << 20, 200_000, 64
#: Text of a range of documents, which is one file (32 MB of text are some 20 MB of ids; its index is one task's).
FILE_BYTES = 32 << 20

#: ASCII signs that end words, and words of small Latin letters.
_SIGNS = string.punctuation
_LATIN = re.compile("[a-zß-öø-ÿ]+")

MANIFEST = "shard string, n_tokens bigint, n_docs bigint, low bigint"


class _Letters(dict):
    """What the tokenizer's model sees of a letter, by code point."""

    def __init__(self, tokenizer):
        super().__init__()
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str if tokenizer.pre_tokenizer else lambda c: [(c, None)]

    def __missing__(self, point: int) -> str:
        self[point] = "".join(piece for piece, _ in self.split(chr(point)))
        return self[point]


class _Tails(dict):
    """Ids of the signs at a word's end, or None where they don't stand for themselves behind a letter."""

    def __init__(self, whole):
        super().__init__()
        self.whole = whole

    def __missing__(self, signs: str) -> bytes | None:
        own = self.whole(signs) if self.whole(f"a{signs}") == self.whole("a") + self.whole(signs) else None
        if len(self) < 10_000:
            self[signs] = own
        return own


class _Words(dict):
    """Ids of words; what is missing comes from the words of a while ago or from the encoder."""

    def __init__(self, coder: Encoder):
        super().__init__({"": b""})
        self.coder = coder

    def __missing__(self, word: str) -> bytes:
        ids = self.coder.older.get(word)
        if ids is None:
            ids = self.coder._word(word)
        if len(word) <= LONG:
            self[word] = ids
        return ids


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker, with the words it remembers."""
    return Encoder(path)


class Encoder:
    """Ids of whole texts. A tokenizer that neither keeps nor joins over white space encodes the words
    between spaces and line ends one by one, so each distinct word is encoded once and remembered.
    ASCII texts are put in lower case first, as the tokenizer does.
    Texts that hold an added token's content, in whatever case, go to the tokenizer whole, as do all
    texts of a tokenizer that keeps or joins over white space.
    """

    MARK = "\x01"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        #: Words of late, and the REMEMBERED ones before them.
        self.known: dict[str, bytes] = _Words(self)
        self.older: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        mark, both = self._ids(self.MARK), self._ids(f"a {self.MARK} A")
        # One id that stands alone, and letters whose case doesn't count.
        self.joins = len(mark) == 1 and both == [*self._ids("a"), *mark, *self._ids("a")]
        self.mark = mark[0]
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.letters = _Letters(self.tokenizer)
        trial = ["a", "thandedble", "éelletréoi", "übergößen"]
        self.plain = self.joins and all(self._plain(w) == array(self.code, self._ids(w)).tobytes() for w in trial)
        self.tails = _Tails(self._whole)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _plain(self, word: str) -> bytes:
        """Ids of a word of small Latin letters, which the model sees as one piece."""
        return array(self.code, [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))]).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word, which follow from it without case, and without the signs that end it, where they
        stand for themselves behind a letter or digit."""
        tail = b""
        bare = word.rstrip(_SIGNS)
        if len(bare) < len(word) and (c := bare[-1:]).isalnum() and c <= "\xff" and (own := self.tails[word[len(bare) :]]) is not None:
            tail = own
        else:
            bare = word
        if bare.isascii() or max(bare) <= "\xff":
            bare = bare.lower()
        if bare != word:
            return self.known[bare] + tail
        return self._plain(word) if self.plain and _LATIN.fullmatch(word) else self._whole(word)

    def _whole(self, text: str) -> bytes:
        return np.array(self._ids(text), self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.joins:
            return [self._whole(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = _Words(self), self.known
        out = []
        for text in texts:
            low = text.lower()
            if any(a in low for a in self.added):
                out.append(self._whole(text))
            else:
                out.append(b"".join(map(self.known.__getitem__, (low if text.isascii() else text).replace("\n", " ").split(" "))))
        return out


class _Writer:
    """Appends documents to a shard; sequences go out as soon as a batch of them is full."""

    def __init__(self, fs, path: str, attempt: int, dtype: np.dtype, length: int, batch: int):
        self.fs, self.path, self.dtype, self.length, self.batch = fs, path, dtype, length, batch
        self.aside = f"{attempt}.part"
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.kind, self.waiting, self.size, self.total = kind, [], 0, 0
        self.sink = fs.open_output_stream(f"{path}.arrow.{self.aside}")
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.index: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.index.append((doc_id, self.total, n))
        self.waiting.append(ids)
        self.size, self.total = self.size + n, self.total + n
        if self.size >= self.length * self.batch:
            self._flush(self.length * self.batch)

    def _flush(self, unit: int) -> None:
        flat = np.frombuffer(b"".join(self.waiting), self.dtype)
        whole = len(flat) // unit * unit
        for begin in range(0, whole, unit):
            self._write(flat[begin : begin + unit], unit)
        self.waiting, self.size = [flat[whole:].tobytes()], len(flat) - whole

    def _write(self, flat: np.ndarray, used: int) -> None:
        mask = pa.array(np.arange(len(flat)) < used)
        ids = pa.FixedSizeListArray.from_arrays(pa.array(flat, self.kind), self.length)
        self.file.write_batch(pa.record_batch([ids, pa.FixedSizeListArray.from_arrays(mask, self.length)], schema=self.schema))

    def close(self) -> tuple[int, int]:
        if self.size:
            rows = -(-self.size // self.length)
            flat = np.zeros(rows * self.length, self.dtype)
            flat[: self.size] = np.frombuffer(b"".join(self.waiting), self.dtype)
            self._write(flat, self.size)
        self.file.close()
        self.sink.close()
        ids, starts, counts = zip(*self.index, strict=True)
        index = pa.record_batch([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "start", "n_tokens"])
        with self.fs.open_output_stream(f"{self.path}.index.{self.aside}") as sink, pa.ipc.new_file(sink, index.schema) as out:
            out.write_batch(index)
        for kind in ("index", "arrow"):
            self.fs.move(f"{self.path}.{kind}.{self.aside}", f"{self.path}.{kind}")
        return self.total, len(self.index)


def write(docs: DataFrame, folder: str, tokenizer: str, doc_id="doc_id", text="text", end: int = END, length: int = SEQUENCE, batch: int = BATCH) -> DataFrame:
    """Write docs below folder (a URI that all executors reach) in ascending order of their ids.

    Returns the manifest: a row (shard, n_tokens, n_docs, low id) per file, in the order of the shards.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    manifest = f"{folder}/manifest"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        ids_of, writer = encoder(tokenizer), None
        tail, low = np.array([end], ids_of.dtype).tobytes(), None
        for shard in common.shards(batches, 1, SHARD_BYTES):
            ids = shard.column(0).to_pylist()
            if writer is None:
                fs, path = pafs.FileSystem.from_uri(folder)
                fs.create_dir(path)
                name, low = f"part-{TaskContext.get().partitionId():06d}", ids[0]
                # Attempts of one task write aside from each other; what is moved into place is the same.
                writer = _Writer(fs, f"{path}/{name}", TaskContext.get().taskAttemptId(), ids_of.dtype, length, batch)
            texts = [t or "" for t in shard.column(1).to_pylist()]
            for i, data in zip(ids, ids_of.encode(texts), strict=True):
                writer.add(i, data + tail)
        if writer is not None:
            total, n = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [name], "n_tokens": [total], "n_docs": [n], "low": pa.array([low], pa.int64())})

    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("m"))
    # A hot id is dealt by its texts, and one text of it by its rows, which are alike.
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    ranges = max(spark.sparkContext.defaultParallelism, math.ceil(n_bytes / FILE_BYTES))
    ordered = rows.repartitionByRange(ranges, F.col("i").asc_nulls_first(), "h", "m").sortWithinPartitions(F.col("i").asc_nulls_first(), "h", "t").select("i", "t")
    ordered.mapInArrow(task, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


class Shard:
    """A written shard: sequences by number and documents' ids, without copying what a memory map holds."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs as pafs

        fs, path = pafs.FileSystem.from_uri(folder)
        local = isinstance(fs, pafs.LocalFileSystem)
        source = pa.memory_map(f"{path}/{name}.arrow") if local else fs.open_input_file(f"{path}/{name}.arrow")
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        with fs.open_input_stream(f"{path}/{name}.index") as f:
            self.index = pa.ipc.open_file(pa.BufferReader(f.read())).read_all()

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view) and mask of sequence k."""
        batch = self.file.get_batch(k // self.rows)
        at = k % self.rows
        return self._flat(batch)[at * self.length : (at + 1) * self.length], batch.column("mask")[at].values

    @staticmethod
    def _flat(batch) -> np.ndarray:
        return batch.column("ids").flatten().to_numpy(zero_copy_only=True)

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Ids of a run of tokens, in views of one batch each."""
        unit = self.length * self.rows
        while n > 0:
            k, at = divmod(start, unit)
            part = self._flat(self.file.get_batch(k))[at : at + n]
            yield part
            start, n = start + len(part), n - len(part)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, read from the files: doc_id, start (among all tokens), n_tokens, ids_crc32."""
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # One row per file; their order is the order of the ids.
    before = F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).cast("long").alias("before"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(folder, name)
                index = shard.index
                starts, counts = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
                crcs = np.zeros(len(starts), np.int64)
                for k, (a, n) in enumerate(zip(starts.tolist(), counts.tolist(), strict=True)):
                    crc = 0
                    for part in shard.tokens(a, n):
                        crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                    crcs[k] = crc
                out = pa.table({"doc_id": index.column("doc_id"), "start": starts + first, "n_tokens": counts, "ids_crc32": crcs})
                yield from out.to_batches(max_chunksize=20_000)

    # One row per shard is little to look at and much to read: every shard is a task.
    each = shards.repartition(spark.sparkContext.defaultParallelism * 4, "shard")
    return each.mapInArrow(documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3(spark, sf_dir: str) -> DataFrame:
    """Token ids of every document, written and read back, by the contract of op3."""
    import public_tokenizers

    folder = common.shared_dir(spark, "token-files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, folder)

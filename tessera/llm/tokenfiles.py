"""Token ids in Arrow IPC files of fixed-size lists.

``write_token_files`` sorts the documents by id in one range shuffle of their texts; each range partition encodes its
texts and writes one shard: ``<shard>.arrow`` holds sequences of equal length as two fixed-size-list columns, ``ids`` and
``mask`` (false on the padding after the shard's last id), and ``<shard>.docs.arrow`` the documents' places. The buffers
are not compressed, so a reader maps a shard and reaches any sequence without copying (``TokenShard``). A shard's name
has a random part and only finished shards are in the manifest, so a lost or repeated task leaves no double ids.

Null and empty texts have the end id alone; equal ids keep the order in which they are read, null ids come first.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import pin, table
from tessera.session import scratch_path

SEQUENCE = 1024          # ids of a sequence
BATCH = 256              # sequences of a record batch
CACHED = 1_500_000       # pieces whose ids a worker keeps; then it starts anew
_BLANK = W.byte_set([0x20, *range(0x09, 0x0E)])
_UNSURE = W.byte_set([0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)])
_WIDE_LEAD = W.byte_set([0xE1, 0xE2, 0xE3])                   # lead bytes of the non-ASCII white space characters
_RIGHT_UNSURE = _UNSURE | W.byte_set([0xC2, 0xE1, 0xE2, 0xE3])


class PieceEncoder:
    """Ids of whole texts, encoding each distinct piece once. A subclass says where texts may be cut and encodes pieces.

    A piece is found again by its 64-bit key and taken only if its bytes are the same.
    """

    dtype = np.uint32

    def __init__(self, cached: int = CACHED):
        self.cached = cached
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.dtype)
        self.begin = np.zeros(0, np.int64)
        self.width = np.zeros(0, np.int64)
        self.bytes = np.zeros(0, np.uint8)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Ascending positions at which pieces begin (every text that is not empty begins one)."""
        raise NotImplementedError

    def encode_pieces(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def _texts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
        raw = data.tobytes()
        return [raw[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist())]

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        for k in range(0, len(keys), 20_000):
            part = slice(k, k + 20_000)
            texts = self._texts(data, starts[part], ends[part])
            found = self.encode_pieces(texts)
            size = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), self.dtype, int(size.sum()))
            raw = np.frombuffer("".join(texts).encode(), np.uint8)
            width = ends[part] - starts[part]
            at = np.searchsorted(self.keys, keys[part])
            self.first = np.insert(self.first, at, len(self.flat) + np.cumsum(size) - size)
            self.begin = np.insert(self.begin, at, len(self.bytes) + np.cumsum(width) - width)
            self.keys = np.insert(self.keys, at, keys[part])
            self.size = np.insert(self.size, at, size)
            self.width = np.insert(self.width, at, width)
            self.flat = np.concatenate([self.flat, flat])
            self.bytes = np.concatenate([self.bytes, raw])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        n = len(data)
        n_rows = len(offsets) - 1
        if not n:
            return np.zeros(0, self.dtype), np.zeros(n_rows, np.int64)
        starts = self.cuts(data, offsets)
        ends = np.append(starts[1:], n)
        keys = W.keys(data, starts, ends)
        distinct, example, piece = np.unique(keys, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = self.keys[place] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if len(self.keys) + new.sum() > self.cached:
            self._clear()
            new = np.ones(len(distinct), bool)
        if new.any():
            self._learn(data, distinct[new], starts[example[new]], ends[example[new]])
        place = np.searchsorted(self.keys, distinct)[piece]
        size, first, flat = self.size[place], self.first[place], self.flat
        width = ends - starts
        other = np.flatnonzero((self.width[place] != width)
                               | ~W.same_runs(data, starts, self.bytes, self.begin[place], np.minimum(width, self.width[place])))
        if len(other):                                            # another piece has this key: these are not kept
            found = self.encode_pieces(self._texts(data, starts[other], ends[other]))
            size[other] = np.fromiter(map(len, found), np.int64, len(found))
            first[other] = len(flat) + np.cumsum(size[other]) - size[other]
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(found), self.dtype, int(size[other].sum()))])
        before = np.cumsum(size) - size
        ids = flat[np.repeat(first - before, size) + np.arange(int(size.sum()))]
        row = np.searchsorted(offsets, starts, "right") - 1
        return ids, np.bincount(row, weights=size, minlength=n_rows).astype(np.int64)


class ByteEncoder(PieceEncoder):
    """A byte-level BPE tokenizer of the ``tokenizers`` library.

    The tokenizer's own first split never joins what stands on both sides of a single ASCII white space between two other
    characters: a space goes with the word after it, any other one stands alone. Texts are cut there; every piece is
    encoded by the library, so the ids are those of the whole text.
    """

    def __init__(self, json: str, plain_specials: bool = False, cached: int = CACHED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        self.tokenizer.encode_special_tokens = plain_specials
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        super().__init__(cached)

    def encode_pieces(self, texts: list[str]) -> list[list[int]]:
        parts = (texts[k:k + 2_000] for k in range(0, len(texts), 2_000))   # the library's results are large, only the ids stay
        return [x.ids for part in parts for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(_BLANK[data])
        row = np.searchsorted(offsets, at, "right") - 1
        begin, end = offsets[row], offsets[row + 1]
        at, begin = at[(at > begin) & (at + 1 < end)], begin[(at > begin) & (at + 1 < end)]
        left, left2, left3 = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        sure = ~_UNSURE[left] & ~_RIGHT_UNSURE[data[at + 1]]
        sure &= ~((left2 == 0xC2) & ((left == 0x85) | (left == 0xA0)) & (at - 2 >= begin)) & ~(_WIDE_LEAD[left3] & (at - 3 >= begin))
        at = at[sure]
        alone = at[data[at] != 0x20] + 1
        return W.marked(len(data), offsets[:-1][offsets[:-1] < offsets[1:]], at, alone)


_ENCODERS: dict[int, ByteEncoder] = {}


def _encoder(json: str) -> ByteEncoder:
    key = zlib.crc32(json.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = ByteEncoder(json)
    return _ENCODERS[key]


def _open(uri: str):
    """(file system, path) of a folder or file that all executors share."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + (uri[5:] if uri.startswith("file:") else os.path.abspath(uri))
    return fs.FileSystem.from_uri(uri)


class _ShardWriter:
    def __init__(self, folder: str, shard: int, dtype, id_type: pa.DataType, sequence: int, batch: int):
        self.files, root = _open(folder)
        self.files.create_dir(root, recursive=True)
        self.name = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}"
        self.base = f"{root}/{self.name}"
        self.kind = pa.from_numpy_dtype(dtype)
        self.sequence, self.batch = sequence, batch
        self.schema = pa.schema([("ids", pa.list_(self.kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.doc_schema = pa.schema([("id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sink = self.files.open_output_stream(self.base + ".arrow")
        self.doc_sink = self.files.open_output_stream(self.base + ".docs.arrow")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.docs = pa.ipc.new_file(self.doc_sink, self.doc_schema)
        self.open_ids: list[np.ndarray] = []
        self.waiting = self.n_tokens = self.n_docs = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        self.docs.write_batch(pa.record_batch([doc_ids, pa.array(starts), pa.array(sizes)], schema=self.doc_schema))
        self.open_ids.append(ids)
        self.waiting += len(ids)
        self.n_tokens += len(ids)
        self.n_docs += len(doc_ids)
        full = self.sequence * self.batch
        if self.waiting >= full:
            flat = np.concatenate(self.open_ids)
            for k in range(0, len(flat) - full + 1, full):
                self._write(flat[k:k + full], full)
            self.open_ids = [flat[len(flat) // full * full:]]
            self.waiting = len(self.open_ids[0])

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(flat, self.kind), self.sequence),
                                              pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence)],
                                             schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            flat = np.concatenate(self.open_ids)
            padded = np.zeros(-(-len(flat) // self.sequence) * self.sequence, flat.dtype)
            padded[:len(flat)] = flat
            self._write(padded, len(flat))
        for x in (self.out, self.docs, self.sink, self.doc_sink):
            x.close()


class TokenShard:
    """Random access to one shard; a local file is mapped, so a slice of a batch is a view of the file."""

    def __init__(self, uri: str):
        files, path = _open(uri)
        local = files.type_name == "local"
        self.reader = pa.ipc.open_file(pa.memory_map(path + ".arrow") if local else files.open_input_file(path + ".arrow"))
        self.docs = pa.ipc.open_file(pa.memory_map(path + ".docs.arrow") if local else files.open_input_file(path + ".docs.arrow"))
        self.sequence = self.reader.schema.field("ids").type.list_size
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 1
        self._at, self._ids = -1, None

    def _batch(self, number: int) -> np.ndarray:
        if number != self._at:
            self._at, self._ids = number, self.reader.get_batch(number).column(0).flatten().to_numpy()
        return self._ids

    def sequence_ids(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of one sequence."""
        batch = self.reader.get_batch(number // self.rows)
        k = number % self.rows
        return (batch.column(0).slice(k, 1).flatten().to_numpy(),
                batch.column(1).slice(k, 1).flatten().to_numpy(zero_copy_only=False))

    def ids(self, start: int, n: int) -> np.ndarray:
        """The ids [start, start + n) of the shard."""
        size = self.rows * self.sequence
        parts = [self._batch(b)[max(start - b * size, 0):start + n - b * size] for b in range(start // size, (start + n - 1) // size + 1)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_token_files(docs: DataFrame, folder: str, tokenizer_json: str, id_column: str = "doc_id", text: str = "text",
                      end_id: int = 0, sequence: int = SEQUENCE, batch: int = BATCH) -> DataFrame:
    """Writes the shards below ``folder`` and returns their manifest: shard, path, n_docs, n_tokens, start.

    ``start`` is the number of ids in all earlier shards; shards follow each other in ascending id order.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(tokenizer_json)   # one tokenizer's file, whose size does not grow
    ordered = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"),
                          F.monotonically_increasing_id().alias("read"))
    ordered = ordered.repartitionByRange("id", "read").sortWithinPartitions("id", "read").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, encoder = None, _encoder(vocabulary.value)
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                writer = _ShardWriter(folder, TaskContext.get().partitionId(), encoder.dtype, b.column(0).type, sequence, batch)
            for first, data, offsets in W.slices(b.column(1)):
                ids, sizes = encoder.encode(data, offsets)
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                writer.add(b.column(0).slice(first, len(sizes)), ids, sizes + 1)
        if writer is not None:
            writer.close()
            yield pa.record_batch({"shard": [TaskContext.get().partitionId()], "path": [f"{folder}/{writer.name}"],
                                   "n_docs": pa.array([writer.n_docs], pa.int64()), "n_tokens": pa.array([writer.n_tokens], pa.int64())})

    shards = pin(ordered.mapInArrow(write, "shard bigint, path string, n_docs bigint, n_tokens bigint"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)   # one row for each shard
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row per document, read back from the files: id, start, n_tokens, ids_crc32 (of the ids as 32-bit numbers)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = TokenShard(path)
                for k in range(shard.docs.num_record_batches):
                    places = shard.docs.get_batch(k)
                    starts, sizes = places.column(1).to_numpy(), places.column(2).to_numpy()
                    crc = [zlib.crc32(shard.ids(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), sizes.tolist())]
                    yield pa.record_batch([places.column(0), pa.array(starts + base), places.column(2), pa.array(crc, pa.int64())],
                                          names=["id", "start", "n_tokens", "ids_crc32"])

    # one partition for each shard
    return manifest.select("path", "start").repartitionByRange(max(manifest.count(), 1), "path").mapInArrow(
        read, f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_index(docs: DataFrame, tokenizer_json: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``docs`` to a fresh folder of the shared store and returns what ``read_token_files`` reads there."""
    spark = docs.sparkSession
    manifest = write_token_files(docs, scratch_path(spark, "tokens"), tokenizer_json, id_column, text)
    read = read_token_files(spark, manifest, docs.schema[id_column].dataType.simpleString())
    return read.withColumnRenamed("id", id_column)


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """The file of an installed public tokenizer."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op5(spark, sf_dir: str) -> DataFrame:
    return token_index(table(spark, sf_dir, "documents"), public_tokenizer())

"""Token ids in sorted-string-table shards.

A shard is one file of documents in ascending key order:

    data blocks   entries (shared key bytes, new key bytes, value bytes,
                  key suffix, value), zstandard, then CRC-32 of the block
    index         per block: last key, offset, length, ids before it, rows
    Bloom filter  about ten bits a key, seven probes
    footer        offsets and lengths of the two, counts, id width, magic

Keys are a null flag and the id in big-endian order with the sign bit
turned, so byte order is id order and nulls come first. Values are the ids
as little-endian unsigned integers of 2 or 4 bytes. A lookup asks the Bloom
filter, then searches the sparse index, then reads one block.

Documents are range-partitioned by (id, hash of the text), so that an id
with very many rows is spread over shards, and each task streams its sorted
rows into shards of bounded size. Files are written under another name and
then renamed, so a task that runs again replaces what it wrote.

Defined results: a null text counts as empty and has only the end id; rows
with the same id are all kept, ordered by their text's hash and text; a
null id sorts first; an empty table writes no shard.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.llm import textops
from leafloom.llm.shared import Workspace
from leafloom.llm.tokens import END_ID, word_ids

MAGIC = b"LEAFSST1"
_FOOTER = struct.Struct("<QQQQQQI4x8s")
_INDEX = struct.Struct("<HQQQQ")
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 8 << 20
_PROBES = 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + i * b) % bits for i in range(_PROBES)]


class ShardWriter:
    """Builds one shard in memory; keys must come in ascending order."""

    def __init__(self, width: int) -> None:
        self.width, self.press = width, zstandard.ZstdCompressor(level=1)
        self.body, self.index, self.keys = bytearray(MAGIC), [], []
        self.block, self.last, self.block_rows, self.block_from = bytearray(), b"", 0, 0
        self.n_ids = 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block_rows:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.block_rows += 1
        self.n_ids += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.block_rows:
            return
        packed = self.press.compress(bytes(self.block))
        self.index.append((self.last, len(self.body), len(packed) + 4, self.block_from, self.block_rows))
        self.body += packed + struct.pack("<I", zlib.crc32(packed))
        self.block, self.block_rows, self.block_from = bytearray(), 0, self.n_ids

    def finish(self) -> bytes:
        self._flush()
        index_at = len(self.body)
        for key, offset, length, before, rows in self.index:
            self.body += _INDEX.pack(len(key), offset, length, before, rows) + key
        bloom_at = len(self.body)
        bits = max(64, 10 * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, dtype=bool)
        for key in self.keys:
            bloom[_probes(key, bits)] = True
        self.body += np.packbits(bloom).tobytes()
        self.body += _FOOTER.pack(index_at, bloom_at - index_at, bloom_at, len(self.body) - bloom_at, len(self.keys), self.n_ids, self.width, MAGIC)
        return bytes(self.body)


class Shard:
    """Reads a shard from bytes or from any seekable file, a block at a time."""

    def __init__(self, source) -> None:
        self.source = pa.BufferReader(source) if isinstance(source, bytes | bytearray | pa.Buffer) else source
        self.source.seek(0, 2)
        size = self.source.tell()
        footer = self._at(max(0, size - _FOOTER.size), _FOOTER.size)
        index_at, index_len, bloom_at, bloom_len, self.n_docs, self.n_ids, self.width, magic = _FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError("not a shard, or cut short")
        raw, at, self.index = self._at(index_at, index_len), 0, []
        while at < index_len:
            n, offset, length, before, rows = _INDEX.unpack_from(raw, at)
            at += _INDEX.size
            self.index.append((raw[at : at + n], offset, length, before, rows))
            at += n
        self.last_keys = [x[0] for x in self.index]
        self.bloom = np.unpackbits(np.frombuffer(self._at(bloom_at, bloom_len), dtype=np.uint8)).astype(bool)
        self.blocks_read = 0
        self._unpress = zstandard.ZstdDecompressor()

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return bytes(self.source.read(length))

    def _block(self, k: int) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, ids of the shard before it, value) of each entry of block k."""
        _, offset, length, before, _ = self.index[k]
        raw = self._at(offset, length)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block's checksum does not hold")
        self.blocks_read += 1
        data, at, key = self._unpress.decompress(raw[:-4]), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            new, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + new]
            at += new
            yield key, before, data[at : at + size]
            at += size
            before += size // self.width

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, dtype=f"<u{self.width}").astype("<u4")

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with that document id."""
        key, out = key_of(doc_id), []
        if not self.bloom[_probes(key, len(self.bloom))].all():
            return out
        for k in range(bisect.bisect_left(self.last_keys, key), len(self.index)):
            found = [(at, v) for at, _, v in self._block(k) if at >= key]
            out += [self.ids(v) for at, v in found if at == key]
            if found and found[-1][0] > key:
                break
        return out

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, ids of the shard before it, its ids) in order."""
        for k in range(len(self.index)):
            for key, before, value in self._block(k):
                yield id_of(key), before, self.ids(value)


def _store(uri: str, data: bytes) -> None:
    """Puts a file into any store that pyarrow knows, whole or not at all."""
    store, path = pafs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    context = TaskContext.get()
    draft = f"{path}.{context.taskAttemptId() if context else 0}.draft"
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, path)


def write_shards(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Plan that writes ``folder/shard-PPPPPPPPP-KKKKKK.sst`` in key order when it runs; a row for each shard.

    Columns: shard (its name without suffix), n_docs, n_ids. Ids of a vocabulary up to
    65,536 take two bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, k = word_ids(tokenizer), TaskContext.get().partitionId(), 0
        width = 2 if max(coder.size, end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        shard = ShardWriter(width)

        def closed() -> pa.RecordBatch:
            name = f"shard-{part:09d}-{k:06d}"
            _store(f"{folder}/{name}.sst", shard.finish())
            return pa.RecordBatch.from_pydict({"shard": [name], "n_docs": [len(shard.keys)], "n_ids": [shard.n_ids]})

        for batch in batches:
            for rows in textops.slices(batch, 1):
                packed = coder.pack([t or "" for t in rows.column(1).to_pylist()])
                for doc_id, ids in zip(rows.column(0).to_pylist(), packed, strict=True):
                    value = ids if width == 4 else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()
                    shard.add(key_of(doc_id), value + end)
                    if len(shard.body) >= shard_bytes:
                        yield closed()
                        shard, k = ShardWriter(width), k + 1
        if shard.keys:
            yield closed()

    keyed = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    placed = keyed.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
    return placed.mapInArrow(run, "shard string, n_docs long, n_ids long")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder).select("path", "content")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Shard]]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield path.rsplit("/", 1)[1].removesuffix(".sst"), Shard(content.as_buffer())


def read_shards(spark: SparkSession, folder: str, most_ids: int = 500_000) -> DataFrame:
    """shard, doc_id, before (ids of the shard before it), ids array<int> of every document."""
    schema = pa.schema([("shard", pa.string()), ("doc_id", pa.int64()), ("before", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, shard in _shards(batches):
            rows, size = [], 0
            for doc_id, before, ids in shard.scan():
                rows.append((name, doc_id, before, ids.view("<i4")))
                size += len(ids)
                if size > most_ids:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return _files(spark, folder).mapInArrow(run, "shard string, doc_id long, before long, ids array<int>")


def shard_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """shard, doc_id, before, n_tokens, ids_crc32 (of unsigned little-endian 32-bit integers) of every document."""
    schema = pa.schema([("shard", pa.string()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, shard in _shards(batches):
            rows = [(name, doc_id, before, len(ids), zlib.crc32(ids)) for doc_id, before, ids in shard.scan()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return _files(spark, folder).mapInArrow(run, "shard string, doc_id long, before long, n_tokens long, ids_crc32 long")


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and checksums of all ``documents``, from the shard files that it writes and reads again."""
    space = Workspace(spark, "sstable")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    shards = space.written(write_shards(docs, space.at("shards")), "manifest")
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    # running sums in two steps: over the shards of each task, and over tasks, of which there are as many as partitions
    part, before = F.substring("shard", 7, 9), lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    within = shards.withColumn("part", part).withColumn("own", F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("shard"))))
    tasks = within.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.sum("n").over(before(Window.orderBy("part"))).alias("earlier"))
    starts = within.join(tasks, "part").select("shard", (F.coalesce("own", F.lit(0)) + F.coalesce("earlier", F.lit(0))).alias("shard_start"))
    rows = shard_checksums(spark, space.at("shards"))
    return rows.join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


QUERIES = {"op9_sstable": op9_sstable}

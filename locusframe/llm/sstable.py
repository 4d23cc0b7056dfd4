"""Sorted-string-table shards of token identifiers.

A shard is a file of records, each followed by one line feed: data blocks, block index, Bloom filter, footer.
Spark's text writer puts them out, so any store that Spark can write to will do, and the task commit keeps
the shards of lost executors out.

* data block: ``<III`` length, raw length and CRC-32 of a zlib body; the body holds entries in key order:
  varints (shared key bytes, further key bytes, value bytes), the further key bytes, the value. Keys are
  prefix-compressed against the entry before them in the block.
* key: empty for a null identifier, else 8 bytes big-endian with the sign bit flipped, so that bytes sort as
  integers do. Repeated identifiers are repeated keys.
* value: the identifiers as little-endian unsigned 16-bit or, in a wide shard, 32-bit integers.
* block index, one entry for each block: varint key length, first key, ``<QII`` offset, length, entries.
* Bloom filter: bit array over the keys, seven probes by double hashing.
* footer: ``<8sQQQQQQI`` magic, index offset and length, filter offset and length, documents, identifiers, width.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path, slices, stash
from .tokens import encode_texts

MAGIC = b"LFSST\x00\x01\n"
FOOTER = struct.Struct("<8sQQQQQQI")
HEAD, PLACE = struct.Struct("<III"), struct.Struct("<QII")
BLOCK_BYTES, BITS_PER_KEY, PROBES = 1 << 18, 10, 7
#: Text of a shard, about; a shard is read by one task.
SHARD_BYTES = 64 << 20


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (int(doc_id) + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class ShardWriter:
    """Yields the records of a shard from entries in key order."""

    def __init__(self, width: int = 2):
        self.width, self.at, self.index, self.keys, self.n_ids = width, 0, [], [], 0
        self._fresh()

    def _fresh(self):
        self.body, self.first, self.last, self.n = bytearray(), b"", b"", 0

    def _emit(self, record: bytes) -> bytes:
        self.at += len(record) + 1
        return record

    def add(self, key: bytes, value: bytes) -> bytes | None:
        """A finished block, if this entry, identifiers of the shard's width, ends one."""
        shared = 0
        if self.n:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.body += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.n, self.n_ids = key, self.n + 1, self.n_ids + len(value) // self.width
        self.keys.append(key)
        return self.flush() if len(self.body) >= BLOCK_BYTES else None

    def flush(self) -> bytes:
        packed = zlib.compress(bytes(self.body), 1)
        record = HEAD.pack(len(packed), len(self.body), zlib.crc32(packed)) + packed
        self.index.append((self.first, self.at, len(record), self.n))
        self._fresh()
        return self._emit(record)

    def finish(self):
        """The records behind the last full block."""
        if self.n:
            yield self.flush()
        index_at = self.at
        index = b"".join(_varint(len(k)) + k + PLACE.pack(*place) for k, *place in self.index)
        yield self._emit(index)
        bloom_at, bits = self.at, max(64, BITS_PER_KEY * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for k in set(self.keys):
            for p in _probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        record = struct.pack("<Q", bits) + bytes(bloom)
        yield self._emit(record)
        yield self._emit(FOOTER.pack(MAGIC, index_at, len(index), bloom_at, len(record), len(self.keys), self.n_ids, self.width))


class Shard:
    """Reads one shard: all entries, or the entries of a key by filter, binary search in the index, and one block."""

    def __init__(self, data: bytes):
        if len(data) <= FOOTER.size or data[-1:] != b"\n":
            raise ValueError("not a shard: its footer is missing")
        magic, index_at, index_len, bloom_at, bloom_len, self.n_docs, self.n_ids, self.width = FOOTER.unpack(data[-1 - FOOTER.size : -1])
        if magic != MAGIC:
            raise ValueError("not a shard: wrong magic")
        self.data, self.blocks = data, []
        at = index_at
        while at < index_at + index_len:
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            self.blocks.append((key, *PLACE.unpack_from(data, at)))
            at += PLACE.size
        self.bits = struct.unpack_from("<Q", data, bloom_at)[0]
        self.bloom = data[bloom_at + 8 : bloom_at + bloom_len]

    def block(self, i: int):
        """(key, identifiers) of block i."""
        _, at, length, n = self.blocks[i]
        size, raw, crc = HEAD.unpack_from(self.data, at)
        packed = self.data[at + HEAD.size : at + length]
        if len(packed) != size or zlib.crc32(packed) != crc:
            raise ValueError(f"block {i} is damaged")
        body, at, key = zlib.decompress(packed), 0, b""
        if len(body) != raw:
            raise ValueError(f"block {i} is damaged")
        for _ in range(n):
            shared, at = _read_varint(body, at)
            more, at = _read_varint(body, at)
            size, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + more]
            yield key, np.frombuffer(body, f"<u{self.width}", size // self.width, at + more)
            at += more + size

    def __iter__(self):
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits))

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The identifiers of each entry of this key."""
        key = key_of(doc_id)
        if not self.blocks or not self.may_have(key):
            return []
        lo, hi = 0, len(self.blocks)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.blocks[mid][0] < key else (lo, mid)
        found, i = [], max(0, lo - 1)
        while i < len(self.blocks) and self.blocks[i][0] <= key:
            found += [ids for k, ids in self.block(i) if k == key]
            i += 1
        return found


def write_shards(docs: DataFrame, out: str, tokenizer: str, end_id: int = 1, width: int = 2, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, append ``end_id`` to each, and write shards below ``out`` in ascending order of the identifier.

    One shuffle of the texts by range of (identifier, text hash, row), to partitions of some ``shard_bytes`` of text, so a hot identifier or text
    is dealt out too. Ranges hold like numbers of rows, not of bytes; a task whose shard reaches ``shard_bytes`` begins another
    one, in a folder by its number, so none is larger but by its last block, index and filter. Null
    identifiers come first; repeated identifiers are ordered by the hash of their text. ``width`` is 2 for vocabularies of
    up to 65,536 entries, else 4.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    kind, end = f"<u{width}", np.array([end_id], f"<u{width}").tobytes()

    def run(batches):
        writer, roll, seq = ShardWriter(width), 0, 0

        def batch(records: list[bytes]) -> pa.RecordBatch:
            nonlocal seq
            seq += len(records)
            return pa.RecordBatch.from_arrays([pa.array([roll] * len(records), pa.int32()), pa.array(range(seq - len(records), seq), pa.int64()), pa.array(records, pa.binary())], names=["roll", "seq", "record"])

        for b in slices(batches):
            out: list[bytes] = []
            coded = encode_texts(b.column(1), tokenizer)
            data, ends = coded.ids.astype(kind).tobytes(), [0, *(coded.ends * width).tolist()]
            for i, k in enumerate(b.column(0).to_pylist()):
                block = writer.add(key_of(k), data[ends[i] : ends[i + 1]] + end)
                if block:
                    out.append(block)
                if writer.at >= shard_bytes:
                    yield batch(out + list(writer.finish()))
                    writer, roll, out = ShardWriter(width), roll + 1, []
            if out:
                yield batch(out)
        if writer.keys:
            yield batch(list(writer.finish()))

    keyed = rows.withColumns({"h": F.xxhash64("t"), "r": F.monotonically_increasing_id()})
    sharded = keyed.repartitionByRange(shards, "k", "h", "r").sortWithinPartitions("k", "h").select("k", "t").mapInArrow(run, "roll int, seq long, record binary")
    ordered = sharded.sortWithinPartitions("roll", "seq").select("roll", F.col("record").cast("string").alias("value"))
    ordered.write.partitionBy("roll").option("lineSep", "\n").text(out)


def read_shards(spark, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of the shards below ``path``: doc_id, start (identifiers of all documents before it), n_tokens, ids_crc32.

    The order of documents is that of the shards. ``with_ids`` adds the identifiers. Running totals need
    one row for each shard only.
    """
    import pyspark.sql.types as T

    schema = "shard string, first binary, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    files = spark.read.schema(T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])).format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for b in slices(batches, 1):
            name, data = b.column(0)[0].as_py(), b.column(1)[0].as_py()
            if not data:
                continue
            shard, at = Shard(data), 0
            first = shard.blocks[0][0]
            for i in range(len(shard.blocks)):
                entries = [(id_of(key), ids.astype("<u4")) for key, ids in shard.block(i)]
                sizes = [len(x) for _, x in entries]
                places = np.cumsum([at, *sizes[:-1]])
                at += sum(sizes)
                columns = [pa.array([name] * len(sizes), pa.string()), pa.array([first] * len(sizes), pa.binary()), pa.array([k for k, _ in entries], pa.int64()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x) for _, x in entries], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([x.astype("i4") for _, x in entries], pa.list_(pa.int32()))] * with_ids, names=["shard", "first", "doc_id", "local", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    entries = stash(files.mapInArrow(run, schema), "sst-entries")
    totals = entries.groupBy("shard").agg(F.min("first").alias("first"), F.sum("n_tokens").alias("total"))
    number = lambda name: F.regexp_extract("shard", rf"{name}(\d+)", 1).cast("long")  # noqa: E731  shards of one key follow each other by range, then by number
    before = F.sum("total").over(Window.orderBy("first", number("part-"), number("roll=")).rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    return entries.join(offsets, "shard").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_shards(docs: DataFrame, tokenizer: str, out: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards of ``docs`` (to a new shared folder unless ``out`` is given) and read them back: doc_id, start, n_tokens, ids_crc32.

    A row for each row, in the order of (identifier, text hash), null identifiers first; null and empty texts have the end
    identifier only, repeated rows an entry each. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    out = out or shared_path(spark, "sst")
    write_shards(docs, out, tokenizer, id_col=id_col, text_col=text_col)
    return read_shards(spark, out)

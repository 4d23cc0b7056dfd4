"""Shared folder, materialised steps and text helpers of the operators."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..steps import Steps, shared_path, ship_package

__all__ = ["Steps", "shared_path"]

#: The memos of this process by module, and the module whose memos were filled last.
_MEMOS: dict[str, list[Memo]] = {}
_LAST = [""]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application; an installed copy goes first.

    Rows go to Python in Arrow batches of at most 512 rows and about 8 MB from then on, where the session has Spark's own
    settings, so that long texts don't add up on either side.
    """
    for key, usual, ours in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "512"), ("spark.sql.execution.arrow.maxBytesPerBatch", None, "8m")):
        if spark.conf.get(key, None) == usual:
            spark.conf.set(key, ours)
    ship_package(spark)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write a step to the shared folder and read it again.

    That cuts the lineage: a lost executor costs a task of the next step, not this one again, and the
    rows are in files that every executor can read.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores in front of those that are names of columns already."""
    taken, out = {x.lower() for x in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text, empty for null."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def flat(texts: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts side by side, and where each begins (one place more than texts); null as empty."""
    if not isinstance(texts, list):
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[places[0] : places[-1]], places - places[0]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 … (``size`` numbers) for each start, one behind the other."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


def word_spans(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of each word, a maximal run without ASCII white space, and the number of words before each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(places), np.int64)
    inside = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[places] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, places)


class Chunks:
    """Parts of texts numbered by content: those of text i are ``at[before[i]:before[i + 1]]``, numbers into ``distinct``."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, before: np.ndarray):
        """``data`` holds the parts, of these sizes, without anything between them."""
        wide = len(data) >= 1 << 31
        ends = np.zeros(len(sizes) + 1, np.int64 if wide else np.int32)
        np.cumsum(sizes, out=ends[1:])
        parts = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        coded = parts.dictionary_encode()
        self.distinct, self.at, self.before = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), before

    @classmethod
    def words(cls, texts: pa.Array | list[bytes]) -> Chunks:
        data, places = flat(texts)
        return cls.of(data, *word_spans(data, places))

    @classmethod
    def of(cls, data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> Chunks:
        """The words that ``word_spans`` gives."""
        return cls(data[~_BLANK[data]], end - start, before)

    def sums(self, of_distinct: np.ndarray) -> np.ndarray:
        """Sum of a number for each distinct part over the parts of each text."""
        total = np.concatenate([[0], np.cumsum(of_distinct[self.at])])
        return total[self.before[1:]] - total[self.before[:-1]]


_RATE, _TABLE = np.uint64(0x9E3779B97F4A7C15 | 5), np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []
HASH_BYTES = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers in which every bit depends on all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class RollingHash:
    """Polynomial hashes of all byte ranges of ``data`` modulo 2^64, from running sums; each byte value stands for a random number."""

    def __init__(self, data: np.ndarray, table: np.ndarray = _TABLE):
        n = len(data) + 1
        if not _POWERS or len(_POWERS[0]) < n:
            size = max(n, HASH_BYTES + 1)
            with np.errstate(over="ignore"):
                _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, r, np.uint64)])) for r in (_RATE, np.uint64(pow(int(_RATE), -1, 1 << 64)))]
        self.run = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(table[data] * _POWERS[0][: n - 1], out=self.run[1:])
        self.back = _POWERS[1]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.run[end] - self.run[start]) * self.back[start]


def lowered(table: np.ndarray = _TABLE) -> np.ndarray:
    """The table of hashes in which A to Z count as a to z."""
    table = table.copy()
    table[65:91] = table[97:123]
    return table


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
    """A 64-bit hash of each of these byte ranges, which come in order and don't overlap; memory for HASH_BYTES of text, or the longest range, at a time."""
    out, at = np.zeros(len(start), np.uint64), 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + HASH_BYTES, "right")))
        low = int(start[at])
        out[at:stop] = RollingHash(data[low : end[stop - 1]], table)(start[at:stop] - low, end[at:stop] - low)
        at = stop
    if _POWERS and len(_POWERS[0]) > 4 * HASH_BYTES:
        _POWERS.clear()
    return mixed(out)


def slices(batches, most: int = 512, most_bytes: int = 1 << 20):
    """Arrow batches of at most so many rows and, of more than one row, about so many bytes; spare memory goes back when all are done.

    The rows of a slice are of like order, not of like length, so a very long text has a slice of its own.
    """
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                sizes += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, start = np.concatenate([[0], np.cumsum(sizes)]), 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(total, total[start] + most_bytes, "right")) - 1
            stop = min(batch.num_rows, start + most, max(start + 1, stop))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Return free memory of this process to the system, so that idle Python workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: A memo holds keys and values of about so many bytes in each of its two generations.
MEMO_BYTES = 24_000_000


class Memo(dict):
    """A bounded memo: ``make`` gets a list of new keys and gives their values.

    Two generations: when the young one is full it becomes the old one, so frequent keys stay. The bound
    is on memory only; a forgotten key is computed again. A process that goes on to another operator's stage
    forgets the memos of the one before, so that those of several stages don't add up.
    """

    def __init__(self, make, entry: int = 160, most: int = MEMO_BYTES):
        """``entry``: bytes of an entry besides its key."""
        super().__init__()
        self.make, self.entry, self.most, self.old, self.owner, self.size = make, entry, most, {}, make.__module__, 0
        _MEMOS.setdefault(self.owner, []).append(self)

    def values_of(self, keys: list) -> list:
        """The values of these keys, each of which is looked up once."""
        if _LAST[0] != self.owner:
            for memo in (m for owner, memos in _MEMOS.items() if owner != self.owner for m in memos):
                memo.clear()
                memo.old, memo.size = {}, 0
            _LAST[0] = self.owner
        if self.size > self.most:
            self.old, self.size = dict(self), 0
            self.clear()
        found = list(map(self.get, keys))
        missing = [k for k, v in zip(keys, found, strict=True) if v is None]
        if missing:
            old = self.old
            fresh = [k for k in missing if k not in old]
            made = dict(zip(fresh, self.make(fresh), strict=True)) if fresh else {}
            for k in missing:
                made[k] = old[k] if k in old else made[k]
            self.update(made)
            self.size += sum(map(len, made)) + self.entry * len(made)
            found = [made[k] if v is None else v for k, v in zip(keys, found, strict=True)]
        return found

"""Product quantisation of vectors with exact integers: codebooks by Lloyd's rounds, assignment by Exponion search.

A vector's part starts at the entry it had in the round before, at distance u. An entry that is as near or nearer lies
within 2u of that entry, so only the front of its list of neighbours, sorted by distance, is looked at. All numbers
are integers, and equal distances go to the lower index, so the result is that of a full search.

Codebooks have a fixed size (4 x 256 entries) and go to the tasks with the code. Each round is one pass over the vectors,
which writes them with their new codes and, as a last row of each task, its sums for each entry; the driver
collects those of all tasks after Spark has added them up.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, give_back, unused

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Labels whose sums are broadcast, some 16 bytes each; more of them are joined by their key.
MOST_LABELS = 100_000
_STEP = "vec_id {0}, label {1}, v array<int>, code binary, part int, entry int, n bigint, sums array<bigint>"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def scaled(values: np.ndarray, width: int) -> np.ndarray:
    """floor(1024 x) of finite values, exact as 1024 is a power of two; an error where squared distances of ``width`` components could pass 2^53."""
    out = np.floor(values.astype(np.float64) * SCALE)
    if len(out) and 4 * width * float(np.abs(out).max()) ** 2 >= 2**53:
        raise ValueError("components are too large for exact distances")
    return out.astype(np.int32)


def _kept(batches, ids: pa.DataType, labels: pa.DataType):
    """Rows (vec_id, vector, label) as integers; those without a vector or with a component that is null or no finite number go."""
    for batch in batches:
        vectors = batch.column(1)
        if pa.types.is_null(vectors.type):
            continue
        flat = vectors.flatten()
        sizes = np.nan_to_num(np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), float)).astype(int)
        value = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(value))])  # null components are NaN here
        ends = np.cumsum(sizes)
        good = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - sizes])
        if not good.any():
            continue
        if len(set(sizes[good])) > 1 or sizes[good][0] % PARTS or not sizes[good][0]:
            raise ValueError(f"vectors must have one length, a multiple of {PARTS}")
        v = scaled(value[np.repeat(good, sizes)], sizes[good][0] // PARTS).reshape(good.sum(), -1)
        rows = batch.filter(pa.array(good))
        n = rows.num_rows
        yield _rows(rows.column(0), rows.column(2), v, np.zeros((n, PARTS), np.uint8), ids, labels)
    give_back()


def _rows(vec_id, label, v: np.ndarray, code: np.ndarray, ids: pa.DataType, labels: pa.DataType) -> pa.RecordBatch:
    n, dim = v.shape
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(v.ravel()))
    codes = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * PARTS), pa.py_buffer(np.ascontiguousarray(code))])
    none = lambda t: pa.nulls(n, t)
    return pa.RecordBatch.from_arrays([vec_id.cast(ids), label.cast(labels), lists, codes, none(pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.int64()))], names=["vec_id", "label", "v", "code", "part", "entry", "n", "sums"])


class Exponion:
    """Nearest entries of one part's codebook."""

    def __init__(self, book: np.ndarray):
        self.book = book.astype(np.float64)
        self.norm = (self.book**2).sum(1)
        apart = self.norm[:, None] - 2 * self.book @ self.book.T + self.norm[None]
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, 1)

    def __call__(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Entry and squared distance of each row of ``x``, searched from the entries ``start``, and how many distances were looked at.

        Sums of products of these integers stay below 2^53, so floating point is exact.
        """
        x = x.astype(np.float64)
        own = (x**2).sum(1)
        near, code, best, seen = ((x - self.book[start]) ** 2).sum(1), start.copy(), np.zeros(len(x)), 0
        by = np.argsort(start, kind="stable")
        for rows in np.split(by, np.flatnonzero(np.diff(start[by])) + 1) if len(x) else []:
            a = start[rows[0]]
            within = np.searchsorted(self.apart[a], 4 * near[rows], "right")  # entries within 2u of entry a, itself included
            by_reach = np.argsort(within, kind="stable")
            for some in np.array_split(by_reach, max(1, len(rows) // 64)):  # rows of like radius together
                most = int(within[some].max())
                entries, r = self.order[a, :most], rows[some]
                d = own[r, None] - 2 * x[r] @ self.book[entries].T + self.norm[entries][None]
                d[np.arange(most)[None] >= within[some][:, None]] = np.inf
                least = d.min(1)
                code[r] = np.where(d == least[:, None], entries[None], len(self.book)).min(1)
                best[r] = least
                seen += int(within[some].sum())
        return code, best.astype(np.int64), seen


def _assigned(batches, books: np.ndarray, ids: pa.DataType, labels: pa.DataType):
    """Rows with new codes, and behind them the sums of each part and entry that this task has met."""
    search = [Exponion(b) for b in books]
    width = books.shape[2]
    sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        v, old = _matrix(batch.column(2), PARTS * width), np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, PARTS)
        code = np.zeros_like(old)
        for p in range(PARTS):
            part = v[:, p * width : (p + 1) * width]
            found, _, _ = search[p](part, old[:, p].astype(np.int64))
            code[:, p] = found
            counts[p] += np.bincount(found, minlength=books.shape[1])
            np.add.at(sums[p], found, part)
        yield _rows(batch.column(0), batch.column(1), v, code, ids, labels)
    part, entry = np.nonzero(counts)
    n = len(part)
    if n:
        yield pa.RecordBatch.from_arrays([pa.nulls(n, ids), pa.nulls(n, labels), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.binary()), pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["vec_id", "label", "v", "code", "part", "entry", "n", "sums"])
    give_back()


def _measured(batches, books: np.ndarray, ids: pa.DataType, labels: pa.DataType):
    search, width = [Exponion(b) for b in books], books.shape[2]
    for batch in batches:
        if not batch.num_rows:
            continue
        v, old = _matrix(batch.column(2), PARTS * width), np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, PARTS)
        code, error = np.zeros_like(old), np.zeros(len(v), np.int64)
        for p in range(PARTS):
            found, apart, _ = search[p](v[:, p * width : (p + 1) * width], old[:, p].astype(np.int64))
            code[:, p] = found
            error += apart
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(ids), batch.column(1).cast(labels), pa.array([c.tobytes().hex() for c in code]), pa.array(error)], names=["vec_id", "label", "code", "error"])
    give_back()


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each vector that is there and all finite.

    Components are floor(1024 x), cut into four parts; codebooks begin with the 256 least vec_ids (equal ones by label and
    vector, nulls first; all of them if there are fewer) and go through four rounds. Equal rows are coded alike and
    counted one by one. Vectors must have one length, a multiple of four, and components small enough for exact distances (a million for 64 components, divided by 1,024); others are an error. Labels that are
    null are one label. An empty table gives no rows. Other columns don't count.
    """
    spark, steps = vectors.sparkSession, Steps(vectors.sparkSession)
    rows = vectors.select("vec_id", F.col(f"`{vector}`").cast("array<double>").alias("_vector"), "label")
    kinds = dict(rows.dtypes)
    schema = _STEP.format(kinds["vec_id"], kinds["label"])
    arrow = spark.createDataFrame([], rows.schema).toArrow().schema
    ids, labels = arrow.field("vec_id").type, arrow.field("label").type
    now = steps.stash(rows.mapInArrow(lambda b: _kept(b, ids, labels), schema), "vectors-0")
    first = now.orderBy("vec_id", "label", "v").limit(ENTRIES).collect()
    if not first:
        return steps.keep(now.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")), "vector-codes")
    books = np.array([r["v"] for r in first], np.int64)
    books = np.stack(np.split(books, PARTS, axis=1))
    for k in range(ROUNDS):
        held = books
        new = steps.stash(now.filter("v is not null").mapInArrow(lambda b, held=held: _assigned(b, held, ids, labels), schema), f"vectors-{k + 1}")
        steps.drop(now)
        now = new
        # at most 4 x 256 entries
        added = now.filter("part is not null").select("part", "entry", "n", F.posexplode("sums")).groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("total")).collect()
        books = books.copy()
        for r in added:
            books[r["part"], r["entry"], r["pos"]] = r["total"] // r["n"]
    final = books
    coded = steps.stash(now.filter("v is not null").mapInArrow(lambda b: _measured(b, final, ids, labels), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"), "vectors-coded")
    told, total = unused(["vec_id", "label", "code", "error"], "_label", "label_error")
    sums = coded.groupBy(F.col("label").alias(told)).agg(F.sum("error").alias(total))
    if sums.count() <= MOST_LABELS:
        sums = F.broadcast(sums)
    out = coded.join(sums, F.col("label").eqNullSafe(F.col(told))).select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
    return steps.keep(out, "vector-codes")

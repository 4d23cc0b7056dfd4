"""Benchmark decontamination by latent semantic retrieval.

Windows of documents and benchmark items are TF-IDF vectors over hashed words, mapped to a low-rank space by a
distributed randomised singular value decomposition. Windows of high cosine with an item are candidates;
a longest common subsequence of words and an answer check decide.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Steps, as_bytes, flat, ragged, slices, span_hashes, unused, word_spans

FEATURES, RANK, OVERSAMPLE = 8192, 48, 8
#: Windows start every STRIDE words, for items of fewer than four strides at most every quarter of the item; so many of a document are searched at a time.
STRIDE, BLOCKS = 8, 16_384
PASSAGE = 40
COSINE, COMMON, ANSWER_WORDS = 0.5, 0.7, 4
#: Items are searched in blocks of about so many bytes, each collected and broadcast.
ITEM_BYTES = 16 << 20
#: ASCII punctuation and blanks: no part of a word's identity at its ends.
_EDGE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_ids(texts: pa.Array | list[bytes]) -> list[np.ndarray]:
    """A 32-bit hash of each word, case folded, without ASCII punctuation around it; words of punctuation alone are left out."""
    texts = texts if isinstance(texts, list) else as_bytes(texts)
    data, places = flat([t.lower() if t.isascii() else t.decode("utf-8", "replace").casefold().encode() for t in texts])
    start, end, before = word_spans(data, places)
    inner = np.append(np.flatnonzero(~_EDGE[data]), len(data))
    first, last = inner[np.searchsorted(inner, start)], inner[np.searchsorted(inner, end) - 1] + 1
    some = np.flatnonzero((first < end) & (len(inner) > 1))
    ids = (span_hashes(data, first[some], last[some]) >> np.uint64(32)).astype(np.uint32)
    cuts = np.searchsorted(some, before).tolist()
    return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _slot(ids: np.ndarray) -> np.ndarray:
    return (ids & np.uint32(FEATURES - 1)).astype(np.int32)


def _stride(n: int) -> int:
    """Words between the windows for an item of n words: 1, 2, 4 or STRIDE, a quarter of n at most."""
    return min(STRIDE, 1 << max(0, n.bit_length() - 3))


def _sums(table: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the rows ``at`` of the table from each start to the next."""
    return np.add.reduceat(table[at], starts, axis=0) if len(at) else np.zeros((0, table.shape[1]), np.float32)


def gram_sketch(rows: list[np.ndarray], idf: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """A'AΩ of the normalised TF-IDF passages of these documents (features x columns of Ω)."""
    rows = [_slot(r) for r in rows if len(r)]
    out, table = np.zeros_like(omega), omega * idf[:, None]
    if not rows:
        return out
    at = np.concatenate(rows)
    starts = np.concatenate([o + np.arange(0, len(r), PASSAGE) for o, r in zip(np.cumsum([0, *map(len, rows[:-1])]), rows, strict=True)])
    ends = np.append(starts[1:], len(at))
    norm = np.maximum(np.add.reduceat(idf[at] ** 2, starts), 1e-12)
    for k in range(0, len(starts), 512):  # blocks that stay in the cache
        a, z = starts[k : k + 512], ends[k : k + 512]
        words = at[a[0] : z[-1]]
        y = _sums(table, words, a - a[0]) / norm[k : k + 512, None]
        passage = np.repeat(np.arange(len(a)), z - a)
        order = np.argsort(words.astype(np.uint16), kind="stable")
        slot, first = np.unique(words[order], return_index=True)
        out[slot] += np.add.reduceat(y[passage[order]], first, axis=0) * idf[slot, None]
    return out


def basis(gram: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors of A from one pass (Nyström): A'A is about Z (Ω'Z)⁺ Z', Z = A'AΩ."""
    core = omega.T @ gram
    s, u = np.linalg.eigh((core + core.T) / 2)
    keep = s > max(s.max(), 1e-12) * 1e-6
    if not keep.any():
        return np.zeros((gram.shape[0], 1), np.float32)
    b = gram @ (u[:, keep] / np.sqrt(s[keep]))
    return np.linalg.svd(b, full_matrices=False)[0][:, :rank].astype(np.float32)


def lcs(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item, given as the bit mask of each of its words, and the words."""
    full = v = (1 << n) - 1
    for w in words:
        m = masks.get(w, 0)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return n - v.bit_count()


class Index:
    """The map into the latent space, and the benchmark's items there by stride and the number of their blocks of so many words."""

    def __init__(self, items: list[tuple[int, bytes]], idf: np.ndarray, vectors: np.ndarray, cosine: float = COSINE, common: float = COMMON):
        self.map = (vectors * idf[:, None]).astype(np.float32)
        self.cosine, self.common, self.groups, self.items, self.place, self.rare = cosine, common, {}, [], [], []
        words: list[tuple[int, int]] = []
        for (item, _), ids in zip(items, word_ids([t for _, t in items]), strict=True):
            if not len(ids):
                continue
            masks: dict[int, int] = {}
            for i, w in enumerate(ids.tolist()):
                masks[w] = masks.get(w, 0) | 1 << i
            rare = sorted(set(ids.tolist()), key=lambda w: (-idf[w & FEATURES - 1], w))[:ANSWER_WORDS]
            v = self.map[_slot(ids)].sum(0)
            stride = _stride(len(ids))
            group = self.groups.setdefault((stride, max(1, round(len(ids) / stride))), [])
            group.append(v / max(np.linalg.norm(v), 1e-9))
            words += [(w, len(self.items)) for w in rare]
            self.place.append((stride, len(group) - 1, max(1, round(len(ids) / stride))))
            self.items.append((item, masks, len(ids), set(rare)))
            self.rare.append(np.array(rare, np.uint32))
        self.groups = {k: np.array(v, np.float32) for k, v in self.groups.items()}
        words.sort()
        self.answer = np.array([w for w, _ in words], np.uint32)
        self.answer_item = np.array([i for _, i in words], np.int64)
        self.answers = np.array([len(x[3]) for x in self.items], np.int64)

    def answered(self, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of document and item, in order, of which the document holds at least half of the item's answer words somewhere."""
        at = np.searchsorted(self.answer, ids)
        at = np.flatnonzero(self.answer[np.minimum(at, len(self.answer) - 1)] == ids)
        seen = np.unique(doc[at].astype(np.int64) << 32 | ids[at])
        word = (seen & 0xFFFFFFFF).astype(np.uint32)
        lo, hi = np.searchsorted(self.answer, word, "left"), np.searchsorted(self.answer, word, "right")
        pairs, counts = np.unique(np.repeat(seen >> 32, hi - lo) * len(self.items) + self.answer_item[ragged(lo, hi - lo)], return_counts=True)
        pairs = pairs[2 * counts >= self.answers[pairs % len(self.items)]]
        return pairs // len(self.items), pairs % len(self.items)

    def search(self, rows: list[np.ndarray]) -> list[tuple[int, int, float, float]]:
        """(row, item, cosine, share of the item in the longest common subsequence) of each item that a document holds, its best place.

        An item can only be held by a document that has half of its answer words, so those pairs are looked up first. All windows
        of about the item's length of such a document are compared with the item; those of high cosine go on to
        the subsequence, where the answer is looked for at the place.
        """
        sizes = np.array([len(r) for r in rows], np.int64)
        if not sizes.sum() or not self.items:
            return []
        docs, items = self.answered(np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes))
        found: dict[tuple[int, int], tuple[float, float]] = {}
        cuts = [0, *(np.flatnonzero(np.diff(docs)) + 1).tolist(), len(docs)] if len(docs) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            by_stride: dict[int, dict[int, list[int]]] = {}
            for i in items[a:b].tolist():
                stride, _, blocks = self.place[i]
                by_stride.setdefault(stride, {}).setdefault(blocks, []).append(i)
            for stride, groups in by_stride.items():
                self._search(rows[docs[a]], int(docs[a]), stride, groups, found)
        return [(d, self.items[i][0], c, s) for (d, i), (c, s) in sorted(found.items())]

    def _search(self, ids: np.ndarray, doc: int, stride: int, groups: dict[int, list[int]], found: dict) -> None:
        """Windows of a document against items of one stride, by their number of blocks; better places go to ``found``."""
        longest = max(groups) * stride
        step = -(-max(BLOCKS * stride, longest) // STRIDE) * STRIDE  # pieces begin at windows of the whole document
        for offset in range(0, max(1, len(ids) - longest), step):
            piece = ids[max(0, offset - 2 * STRIDE) : offset + step + longest + 2 * STRIDE]
            starts = np.arange(0, len(piece), stride)
            total = np.zeros((len(starts) + 1, self.map.shape[1]))
            np.cumsum(_sums(self.map, _slot(piece), starts), axis=0, out=total[1:], dtype=np.float64)
            for blocks, items in groups.items():
                first = np.arange(max(1, len(starts) - blocks + 1))  # of a shorter document, one window
                w = (total[np.minimum(first + blocks, len(starts))] - total[first]).astype(np.float32)
                near = w @ self.groups[stride, blocks][[self.place[i][1] for i in items]].T
                size = np.maximum(np.sqrt(np.einsum("ij,ij->i", w, w)), 1e-9)
                high = near >= self.cosine * size[:, None]
                low, top = np.maximum(0, first * stride - 2 * STRIDE), np.minimum(len(piece), (first + blocks) * stride + 2 * STRIDE)
                for k, item in enumerate(items):
                    seen = np.concatenate([[0], np.cumsum(np.isin(piece, self.rare[item]))])
                    high[:, k] &= 2 * (seen[top] - seen[low]) >= len(self.rare[item])
                for b, k in zip(*np.nonzero(high), strict=True):
                    _, masks, m, rare = self.items[items[k]]
                    region = piece[low[b] : top[b]].tolist()
                    if 2 * len(rare.intersection(region)) < len(rare):
                        continue
                    share = lcs(masks, m, region) / m
                    if share >= self.common and share > found.get((doc, items[k]), (0, 0))[1]:
                        found[doc, items[k]] = (float(near[b, k] / size[b]), share)


#: Sums that one task adds up.
SUMMED = 64


def fit_space(rows: DataFrame, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Inverse document frequencies over all rows of ``word_rows``, and the basis from one distributed pass over all of them.

    The driver gets sums of FEATURES numbers and of FEATURES x (rank + 8) numbers, in groups added up by the executors.
    """
    spark = rows.sparkSession

    def summed(batches, kind: str, name: str):
        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                x = np.frombuffer(x, kind)
                total = x.astype(np.float64) if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(kind).tobytes()], pa.binary())], names=[name])

    def over(df: DataFrame, kind: str) -> np.ndarray | None:
        """Sum of one binary vector for each row: by tasks, and theirs by fewer tasks until 16 are left."""
        left = -(-df.rdd.getNumPartitions() // SUMMED)
        while left > 16:
            df = df.repartition(left).mapInArrow(lambda bs: summed(bs, kind, "v"), "v binary")
            left = -(-left // SUMMED)
        groups = df.repartition(16).mapInArrow(lambda bs: summed(bs, kind, "v"), "v binary").collect()
        return sum(np.frombuffer(r["v"], kind).astype(np.float64) for r in groups) if groups else None

    df = over(rows.filter("df is not null").select("df"), "<f8")
    n_docs = rows.filter("df is null").count()
    idf = (np.log((1 + n_docs) / (1 + (np.zeros(FEATURES) if df is None else df))) + 1e-3).astype(np.float32)
    width = rank + OVERSAMPLE
    omega = np.random.default_rng(11).standard_normal((FEATURES, width)).astype(np.float32)
    shared = spark.sparkContext.broadcast((idf, omega))

    def sketch(batches):
        idf, omega = shared.value
        total = np.zeros_like(omega)
        for b in slices(batches):
            total += gram_sketch([np.frombuffer(x, "<u4") for x in b.column(0).to_pylist()], idf, omega)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    gram = over(rows.filter("df is null").select("ids").mapInArrow(sketch, "v binary"), "<f4")
    vectors = np.zeros((FEATURES, 1), np.float32) if gram is None else basis(gram.reshape(FEATURES, width), omega.astype(np.float64), rank)
    shared.destroy()
    return idf, vectors


def fit_index(rows: DataFrame, benchmark: DataFrame, rank: int = RANK, item_col: str = "item_id", item_text: str = "text", cosine: float = COSINE, common: float = COMMON) -> Index:
    """The index of a benchmark that is known to fit the driver."""
    idf, vectors = fit_space(rows, rank)
    items = benchmark.select(F.col(item_col).cast("long"), F.col(item_text).cast("string")).filter(F.col(item_col).isNotNull()).collect()
    return Index(sorted((r[0], (r[1] or "").encode()) for r in items), idf, vectors, cosine, common)


def word_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and ids (32-bit word hashes) of each document, and a row of document frequencies (df) for each partition; written once."""

    def run(batches):
        df, names = np.zeros(FEATURES), ["doc_id", "text_hash", "ids", "df"]
        kinds = [key, pa.int64(), pa.binary(), pa.binary()]
        for b in slices(batches):
            rows = word_ids(b.column(1))
            seen = np.unique(_slot(np.concatenate(rows)) + np.repeat(np.arange(len(rows), dtype=np.int32) * FEATURES, [len(r) for r in rows]))
            df += np.bincount(seen & FEATURES - 1, minlength=FEATURES)
            none = pa.nulls(len(rows), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in rows], pa.binary()), none], names=names)
        if df.any():
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((None, None, None, df.tobytes()), kinds, strict=True)], names=names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    key = to_arrow_type(rows.schema["doc_id"].dataType)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text_hash long, ids binary, df binary")


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, common: float = COMMON, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and benchmark item that it holds: doc_id, text_hash, item_id, cosine, common (share of the item in the subsequence).

    Every window of a document that holds half of an item's rarest words is compared with the item. The benchmark is searched in blocks of
    ITEM_BYTES, so neither driver nor tasks hold all of it. Null and empty texts hold nothing; null or empty
    items, and items without an identifier, are not looked for. Repeated documents are reported as often as they
    occur; identifiers of documents may be of any type. Documents shorter than an item are one window. Without benchmark or documents the result is empty.
    """
    steps = Steps(docs.sparkSession)
    rows = steps.stash(word_rows(docs, id_col, text_col), "leak-words")
    space = fit_space(rows)
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).filter("i is not null and t <> ''").distinct()
    n_blocks = max(1, -(-(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // ITEM_BYTES))
    block = F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks))
    found = [_leaks(rows, Index(sorted((r["i"], r["t"].encode()) for r in items.filter(block == k).collect()), *space, cosine, common), steps) for k in range(n_blocks)]
    return steps.keep(functools.reduce(DataFrame.union, found), "leak-found")


def _leaks(rows: DataFrame, index: Index, steps: Steps) -> DataFrame:
    """The hits of one block of items, written before the next block is collected."""
    shared, key = rows.sparkSession.sparkContext.broadcast(index), to_arrow_type(rows.schema["doc_id"].dataType)

    def run(batches):
        model = shared.value
        for b in slices(batches):
            ids, hashes, words = (b.column(i).to_pylist() for i in range(3))
            out = [(ids[r], hashes[r], *hit) for r, *hit in model.search([np.frombuffer(x, "<u4") for x in words])]
            if out:
                kinds = [key, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "text_hash", "item_id", "cosine", "common"])

    hits = steps.stash(rows.filter("df is null").select("doc_id", "text_hash", "ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text_hash long, item_id long, cosine double, common double"), "leak-block")
    shared.destroy()
    return hits


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all their columns."""
    i, h = unused(docs.columns, "_lf_i", "_lf_h")
    found = leaks(docs, benchmark, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(h))
    return docs.join(found, same, "left_anti")

"""Quality scores by nearest-neighbour voting in a latent-semantic space.

The labelled vectors are those of a bounded sample; every document is compared with all of them, exactly, in
blocks, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Chunks, Memo, slices

#: The labelled sample holds at most so many rows of each label, of at most so many words in all; they bound the fit on
#: the driver and what is broadcast (sample x rank + features x rank numbers of four bytes).
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 24_000_000
FEATURES, RANK, NEIGHBOURS = 4096, 48, 15
SHAPES = 512
_LETTERS, _DIGITS, _REPEAT = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+", re.S)
_MEMOS: dict[int, Memo] = {}


def _slots(words: list[bytes]) -> list[int]:
    """Feature of each word (low 16 bits) and of its shape: letters and digits give a class, other characters stay, runs count once."""
    out = []
    for w in words:
        t = w.decode("utf-8", "replace")
        shape = "A" if t.isupper() and len(t) > 1 else "a"
        if not t.isalpha():
            shape = _REPEAT.sub(r"\1", _DIGITS.sub("0", _LETTERS.sub(shape, t)))[:16]
        out.append(SHAPES + 16 + zlib.crc32(t.lower().encode()) % (FEATURES - SHAPES - 16) | zlib.crc32(shape.encode()) % SHAPES << 16)
    return out


def _memo() -> Memo:
    if 0 not in _MEMOS:
        _MEMOS[0] = Memo(_slots)
    return _MEMOS[0]


def features(texts: pa.Array | list[bytes]) -> np.ndarray:
    """A row of FEATURES damped term counts for each text: hashed words, hashed shapes, and bins of three ratios.

    The ratios (distinct words, words equal to the one before, length) take one of a few bins each, as a term
    of its own. An empty text is a zero row but for its bins.
    """
    words = Chunks.words(texts)
    code = np.array(_memo().values_of(words.distinct.to_pylist()), np.int64)
    all_words, all_shapes = (code & 65535)[words.at] if len(code) else code, (code >> 16)[words.at] if len(code) else code
    x = np.zeros((len(texts), FEATURES), np.float32)
    for row, a, b in zip(x, words.before[:-1].tolist(), words.before[1:].tolist(), strict=True):
        n = b - a
        if n:
            word = all_words[a:b]
            row[:] = np.log1p(np.bincount(word, minlength=FEATURES))
            row[:SHAPES] = 12 * np.sqrt(np.bincount(all_shapes[a:b], minlength=SHAPES) / n)
            same = float((word[1:] == word[:-1]).mean()) if n > 1 else 0.0
            row[SHAPES + min(3, int(same * 8))] = 6
            row[SHAPES + 4 + min(3, int(len(np.unique(words.at[a:b])) / n**0.7))] = 3
        row[SHAPES + 8 + min(7, int(np.log10(n + 1) * 2))] = 1
    return x


def randomised_svd(x: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors (columns) by a range finder with two power rounds."""
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(x @ rng.standard_normal((x.shape[1], rank + 8)).astype(np.float32))[0]
    for _ in range(2):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    return np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)


class Voter:
    """Latent vectors of labelled texts and the map into their space. Without labels every score is the prior."""

    def __init__(self, texts: list[bytes], labels: list[int], prior: float, rank: int = RANK, neighbours: int = NEIGHBOURS):
        self.prior, self.k = float(prior), neighbours
        self.labels = np.array(labels, np.float32)
        if len(texts) == 0:
            self.map = np.zeros((FEATURES, 1), np.float32)
            self.vectors = np.zeros((0, 1), np.float32)
            return
        x = np.concatenate([features(texts[i : i + 256]) for i in range(0, len(texts), 256)])
        idf = np.log((1 + len(texts)) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.1
        x *= idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        self.map = randomised_svd(x, min(rank, *x.shape)) * idf[:, None]
        self.vectors = self.embed(texts)
        # a label's weight undoes its share of the sample, so that the vote is about the share among all labelled rows
        share = max(1e-6, min(1 - 1e-6, self.labels.mean()))
        self.weight = np.where(self.labels > 0.5, self.prior / share, (1 - self.prior) / (1 - share)).astype(np.float32)

    def embed(self, texts: pa.Array | list[bytes]) -> np.ndarray:
        v = np.concatenate([features(texts[i : i + 256]) @ self.map for i in range(0, len(texts), 256)])
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: pa.Array | list[bytes]) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(texts), self.prior)
        near = self.embed(texts) @ self.vectors.T
        k = min(self.k, near.shape[1])
        at = np.argpartition(near, -k, axis=1)[:, -k:]
        sim = np.take_along_axis(near, at, 1)
        w = np.maximum(sim, 0.0) ** 4 * self.weight[at]
        vote = (w * self.labels[at]).sum(1) + 1e-3 * self.prior
        return vote / (w.sum(1) + 1e-3)


def held_out(id_col: str = "doc_id"):
    """True for rows whose CRC-32 of the identifier as text leaves 2 when divided by 4; false for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Voter:
    """Fit on labelled rows outside the held-out quarter.

    The prior is the share of label 1 among all of them. The sample is at most ``rows`` rows of each label, those
    with the smallest hash of their text, and at most ``max_bytes`` of text; both bounds are parameters. Null
    labels and labels other than 0 and 1 are left out; a row with several labels counts with each, equal texts count
    once for a label. Identifiers are compared as text, so they may be of any type.
    """
    marked = labels.select(F.col(id_col).cast("string").alias("_id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1)")
    train = marked.filter(~held_out("_id") & F.col("_id").isNotNull())
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col).cast("string").alias("_id")
    hashed = docs.select(key, F.xxhash64(text).alias("h"), F.octet_length(text).alias("size"))  # texts don't move
    known = train.groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in known}
    prior = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    light = hashed.join(train, "_id")
    chosen = []
    for y in (0, 1):  # two bounded reports of the smallest hashes
        got = light.filter(F.col("y") == y).dropDuplicates(["h"]).orderBy("h").limit(rows).collect()
        total = 0
        for r in got:
            if total + r["size"] <= max_bytes // 2:  # a text that doesn't fit is passed over, those behind it aren't
                total += r["size"]
                chosen.append((r["_id"], r["h"], r["y"]))
    if not chosen:
        return Voter([], [], prior)
    want = docs.sparkSession.createDataFrame(chosen, "_id string, h long, y int")
    texts = docs.select(key, F.xxhash64(text).alias("h"), text.alias("t")).join(F.broadcast(want), ["_id", "h"])
    got = texts.groupBy("h", "y").agg(F.min("t").alias("t")).orderBy("h", "y").collect()  # a row for each chosen text and label, however often it occurs
    return Voter([r["t"].encode() for r in got], [r["y"] for r in got], prior)


def score_quality(docs: DataFrame, voter: Voter, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", keep_hash: bool = False) -> DataFrame:
    """Identifier, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= threshold) of each row.

    With ``keep_hash`` also text_hash, Spark's xxhash64 of the text.

    Whole texts; null texts are scored as empty ones. Narrow: the fitted model is broadcast, blocks of 256
    rows are compared with all labelled vectors.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(voter)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = shared.value
        for b in slices(batches, 256):
            s = model.scores(b.column(1)).astype(float).clip(0.0, 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array((s >= threshold).astype("i4"), pa.int32()), *(b.column(i) for i in range(3, b.num_columns))], names=[id_col, "held_out", "score", "predicted", *["text_hash"] * keep_hash])

    columns = [id_col, text_col, held_out(id_col).alias("_held"), *[F.xxhash64(text_col).alias("_hash")] * keep_hash]
    return docs.select(*columns).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int" + ", text_hash long" * keep_hash)

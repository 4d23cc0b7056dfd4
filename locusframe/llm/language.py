"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

A language gives each piece of the vocabulary a probability. The probability of a word is the sum over all
its segmentations into pieces, by the forward algorithm; a text's is the product over its words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Chunks, Memo, flat, mixed, ragged, slices, word_spans
from .quality import held_out
from .segments import HashIndex

#: Bounds of the fit: of each language so many documents, and so many bytes of them.
SAMPLE_DOCS, SAMPLE_BYTES = 400, 1_000_000
#: Words of so many letters in all are summed together.
GROUP_LETTERS = 60_000
_PIECES: dict[str, "Vocabulary"] = {}
_SUMS: dict[str, Memo] = {}
_C = np.uint64(0x9E3779B97F4A7C15)
#: ASCII letters in lower case, other bytes of ASCII as blanks.
_PLAIN = np.array([ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(128)] + list(range(128, 256)), np.uint8)


class Vocabulary:
    """Lower-cased letter pieces of a SentencePiece model, each with a number, found by the hash of their letters."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {sp.id_to_piece(i).lstrip("▁").lower() for i in range(sp.get_piece_size())}
        self.pieces = sorted(p for p in pieces if p.isalpha())
        self.longest = max(map(len, self.pieces))
        self.index = HashIndex(np.array([_range_hashes(np.array(list(map(ord, p)), np.uint64), len(p))[-1][0] for p in self.pieces], np.uint64))


def _range_hashes(letters: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of the ranges of 1, 2, … letters from each place; the last ones of a longer length are missing."""
    out, h = [], np.zeros(len(letters), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, min(longest, len(letters)) + 1):
            h = (h[: len(letters) - n + 1] + letters[n - 1 :] + np.uint64(1)) * _C
            h = h ^ (h >> np.uint64(29))
            out.append(mixed(h))
    return out


def vocabulary(path: str) -> Vocabulary:
    """One for each process."""
    if path not in _PIECES:
        _PIECES[path] = Vocabulary(path)
    return _PIECES[path]


def letter_chunks(texts: pa.Array | list[bytes]) -> tuple[Chunks, list[list[str]]]:
    """Texts in runs without blanks and other characters of ASCII than letters, and of each distinct one its words, runs of letters in lower case.

    Letters are characters of the general categories L.
    """
    data, places = flat(texts)
    data = _PLAIN[data]
    chunks = Chunks.of(data, *word_spans(data, places))
    words = []
    for c in chunks.distinct.to_pylist():
        t = c.decode("utf-8", "replace").lower()
        words.append([t] if t.isalpha() else "".join(x if x.isalpha() else " " for x in t).split())
    return chunks, words


class Lattice:
    """The pieces of several words: for each place of a word, which pieces end there.

    Words are in descending order of length, so those that reach a place come first. ``ending[j]`` has, for words of more
    than j letters, the piece of each length that ends behind letter j: an unknown letter is ``len(pieces)``, no piece one more.
    """

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        self.order = np.argsort([-len(w) for w in words], kind="stable")
        text = "".join(words[i] for i in self.order)
        self.sizes = np.array([len(words[i]) for i in self.order], np.int64)
        starts = np.cumsum(self.sizes) - self.sizes
        letters = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.longest = int(min(vocabulary.longest, self.sizes[0])) if len(words) else 1
        unknown = len(vocabulary.pieces)
        piece = np.full((len(letters), self.longest), unknown + 1, np.int32)  # of each end and length less 1
        place = ragged(np.zeros(len(starts), np.int64), self.sizes)
        for n, h in enumerate(_range_hashes(letters, self.longest)):
            got = vocabulary.index(h)
            got[got < 0] = unknown + (n > 0)
            inside = place[n:] >= n
            piece[n:, n][inside] = got[inside]
        reach = np.searchsorted(-self.sizes, -np.arange(1, int(self.sizes[0]) + 1), "right") if len(words) else []
        self.ending = [piece[starts[:r] + j] for j, r in enumerate(reach)]

    def forward(self, table: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Logarithm of the summed probability of all segmentations of each prefix (by length, words x languages), and of each whole word.

        Sums are taken relative to the largest of the last places, so no length underflows.
        """
        k = table.shape[1]
        prefix, whole = [np.zeros((len(self.sizes), k))], np.zeros((len(self.sizes), k))
        for j, piece in enumerate(self.ending):
            r, n = len(piece), min(self.longest, j + 1)
            before = np.stack([prefix[j - x][:r] for x in range(n)], 1)  # by length less 1
            top = before.max(1)
            total = (np.exp(before - top[:, None]) * table[piece[:, :n]]).sum(1)
            prefix.append(top + np.log(np.maximum(total, 1e-300)))
            whole[:r] = prefix[-1]
        out = np.empty_like(whole)
        out[self.order] = whole
        return prefix, out

    def expected(self, table: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, over all segmentations of words that occur ``weight`` times (words x languages)."""
        k, weight = table.shape[1], weight[self.order]
        prefix, _ = self.forward(table)
        most = len(self.ending)
        rows = [len(p) for p in self.ending]
        new = np.zeros_like(table)
        behind: list[np.ndarray] = [np.full((r, k), -np.inf) for r in [len(self.sizes), *rows]]  # of each length of prefix
        whole = np.zeros((len(self.sizes), k))
        for j in range(most):
            whole[: rows[j]] = prefix[j + 1]
        for j in range(most - 1, -1, -1):
            r, piece = rows[j], self.ending[j]
            last = self.sizes[:r] == j + 1
            behind[j + 1][last] = 0.0
            for x in range(min(self.longest, j + 1)):
                p = table[piece[:, x]]
                with np.errstate(divide="ignore"):
                    path = np.log(p) + behind[j + 1]
                at = j - x
                behind[at][:r] = np.logaddexp(behind[at][:r], path)
                share = np.exp(prefix[at][:r] + path - whole[:r]) * weight[:r]
                np.add.at(new, piece[:, x], share)
        return new


def grouped(words: list[str]):
    """Numbers of words of like length, in groups of about GROUP_LETTERS letters."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    group, total = [], 0
    for i in order:
        group.append(i)
        total += len(words[i])
        if total >= GROUP_LETTERS:
            yield group
            group, total = [], 0
    if group:
        yield group


class Languages:
    """Piece probabilities of each language; ``table`` is pieces, unknown letter and a row of zeros x languages."""

    def __init__(self, names: list[str], table: np.ndarray, path: str):
        self.names, self.table, self.path = names, table, path
        self.key = hashlib.sha1(repr((names, path)).encode() + table.tobytes()).hexdigest()

    def words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language: the forward sum over all segmentations, whatever the length."""
        out = np.zeros((len(words), len(self.names)))
        for group in grouped(words):
            out[group] = Lattice([words[i] for i in group], vocabulary(self.path)).forward(self.table)[1]
        return out


def fit_pieces(counts: dict[str, dict[str, int]], path: str, rounds: int = 4, smoothing: float = 0.1) -> Languages:
    """Expectation-maximisation of piece probabilities from word counts of each language (forward-backward)."""
    names = sorted(counts)
    v, k = len(vocabulary(path).pieces) + 2, len(names)
    total: dict[str, np.ndarray] = {}
    for x, name in enumerate(names):
        for w, n in counts[name].items():
            total.setdefault(w, np.zeros(k))[x] += n
    words = list(total)
    groups = [([words[i] for i in g], np.array([total[words[i]] for i in g])) for g in grouped(words)]

    def normal(x: np.ndarray) -> np.ndarray:
        x = x + smoothing
        x[-1] = 0
        return x / x.sum(0)

    table = np.zeros((v, k))
    for some, weight in groups:  # first guess: pieces as often as words contain them, longer ones favoured
        lattice = Lattice(some, vocabulary(path))
        for piece in lattice.ending:
            for x in range(piece.shape[1]):
                np.add.at(table, piece[:, x], weight[lattice.order][: len(piece)] * (x + 1))
    table = normal(table)
    for _ in range(rounds):
        table = normal(sum((Lattice(some, vocabulary(path)).expected(table, weight) for some, weight in groups), np.zeros((v, k))))
    return Languages(names, table, path)


def fit_languages(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Learn from text and non-null language of rows outside the held-out quarter.

    A bounded sample: of each language the ``sample_docs`` distinct texts with the smallest hash, less those that don't fit
    into ``sample_bytes``. Only hashes are ranked (a window limit that Spark applies in each partition first); the texts of
    the sample, whole, are picked by a broadcast of their hashes, whose number is bounded by languages x sample_docs.
    """
    text = F.col(text_col).cast("string")
    known = docs.filter(~held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), text.alias("t"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("size")).filter("lang is not null and t is not null")
    best = Window.partitionBy("lang").orderBy("h")
    ranked = known.groupBy("lang", "h").agg(F.max("size").alias("size")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= sample_docs)
    chosen, left = [], {}
    for r in ranked.select("lang", "h", "size").orderBy("lang", "h").collect():
        if left.setdefault(r["lang"], sample_bytes) >= r["size"]:
            left[r["lang"]] -= r["size"]
            chosen.append((r["lang"], r["h"]))
    if not chosen:
        return fit_pieces({}, path)
    want = docs.sparkSession.createDataFrame(chosen, "lang string, h long")
    counts: dict[str, dict[str, int]] = {}
    for r in known.join(F.broadcast(want), ["lang", "h"]).groupBy("lang", "h").agg(F.min("t").alias("t")).collect():
        mine = counts.setdefault(r["lang"], {})
        chunks, words = letter_chunks([r["t"].encode()])
        for x, n in enumerate(np.bincount(chunks.at, minlength=len(words)).tolist()):
            for w in words[x]:
                mine[w] = mine.get(w, 0) + n
    return fit_pieces(counts, path)


def detect(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier, held_out, lang_pred and score (posterior of the prediction, 0 to 1) of each row.

    ``und`` with score 0 for null texts and texts without a letter (general category L), and where no language was learned.
    Ties go to the first name. Narrow; each distinct word is summed once while the memo holds it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from locusframe.llm.language import _SUMS

        m = shared.value
        k = len(m.names)
        memo = _SUMS.setdefault(m.key, Memo(lambda words: [x.tobytes() for x in m.words(words)]))
        for b in slices(batches):
            n = b.num_rows
            chunks, parts = letter_chunks(b.column(1))
            pred, score = np.full(n, k), np.zeros(n)
            if k and any(parts):
                new = list({w for p in parts for w in p})
                number = dict(zip(new, range(len(new)), strict=True))
                known = np.frombuffer(b"".join(memo.values_of(new)), float).reshape(-1, k)
                count = np.array(list(map(len, parts)))
                at = np.array([number[w] for p in parts for w in p], np.int64)
                total = np.concatenate([np.zeros((1, k)), np.cumsum(known[at], axis=0)])
                ends = np.cumsum(count)
                each = total[ends] - total[ends - count]
                lettered = chunks.sums(count) > 0
                s = np.stack([chunks.sums(each[:, c]) for c in range(k)], 1)
                s = np.exp(s - s.max(1, keepdims=True))
                pred[lettered] = s.argmax(1)[lettered]
                score[lettered] = (s.max(1) / s.sum(1))[lettered]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([*m.names, "und"], pa.string()).take(pa.array(pred)), pa.array(score)], names=[id_col, "held_out", "lang_pred", "score"])

    return docs.select(id_col, text_col, held_out(id_col).alias("_held")).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")

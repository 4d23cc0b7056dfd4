"""Exact subword counts and identifiers through a memo of chunks, and the prefix table of a text.

A chunk is a maximal run without ASCII white space. The vocabulary's pretokens never span white space, so
the tokens of a text are those of its chunks in order, and those of a chunk those of its pretokens. Each distinct part is
encoded by the library once for as long as the memo holds it. Special strings are handled as the library does by default.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Chunks, Memo, flat, ragged, slices, word_spans

#: Pretokens of up to so many characters are encoded at each cut by the library, longer ones go through the prefix dynamic program; both give its counts.
TABULATED = 256
_LOADED: dict[tuple, object] = {}


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: Classes of bytes: 0 ASCII letters (and letters of two bytes), 1 digits, 2 punctuation, 3 all others, which are never cut off:
#: apostrophes (contractions), angle brackets and bars (special strings), other characters.
_CLASS = np.array([0 if chr(b).isalpha() else 1 if chr(b).isdigit() else 2 if 32 < b < 127 and chr(b) not in "'<>|" else 3 for b in range(128)] + [3] * 128, np.int8)
#: Characters of two bytes from U+00C0 to U+017F that are no letters or change in more than case, as their bytes.
_ODD = np.array([int.from_bytes(c.encode(), "big") for c in "×÷İıĲĳŉſ"])
_SMALL = np.array([ord(chr(b).lower()) if b < 128 else b for b in range(256)], np.uint8)
#: Whether texts are cut between two classes: single digits, and letters and punctuation from each other.
_CUT = np.array([[0, 1, 1, 0], [1, 1, 1, 0], [1, 1, 0, 0], [0, 0, 0, 0]], bool)


class Pretokens(Chunks):
    """The words of texts, cut where the vocabulary's pretokens end for certain.

    Pretokens are contractions, runs of letters, single digits, or runs of other characters, and each is encoded on
    its own, from left to right. ASCII letters are taken as small ones, as the library does, unless special strings may be about.
    ``word_first`` is the first part of each word, ``words_before`` the words before each text, ``ends`` the byte behind each word.
    """

    def __init__(self, texts: pa.Array | list[bytes]):
        data, places = flat(texts)
        start, self.ends, self.words_before = word_spans(data, places)
        kind = _CLASS[data]
        two = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5))
        two = two[(data[two + 1] & 0xC0 == 0x80) & ~np.isin(data[two].astype(np.int32) << 8 | data[two + 1], _ODD)]
        kind[two] = kind[two + 1] = 0
        first = np.zeros(len(data), bool)
        first[1:] = _CUT[kind[:-1], kind[1:]]
        first[start] = True
        edges = np.flatnonzero(first)
        # of a cut that isn't the begin of a word both sides are in a word, since blanks are of the last class
        self.word_first = np.searchsorted(edges, start)
        data = data if b"<|" in data.tobytes() else _SMALL[data]
        behind = np.append(edges[1:], len(data))
        behind[np.append(self.word_first[1:] - 1, len(edges) - 1)[: len(start)]] = self.ends
        sizes = behind - edges
        super().__init__(data[ragged(edges, sizes)], sizes, np.searchsorted(edges, places))
        self.n_bytes, self.places = np.diff(places), places


# The rule by which the vocabulary cuts texts, and the characters that stand for bytes in it.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_SYMBOL = {b: chr(b) if b in _SHOWN else chr(256 + i) for b, i in zip(range(256), np.cumsum([b not in _SHOWN for b in range(256)]) - 1, strict=True)}


class Encoder:
    """Identifiers of pretokens by the library: words many at a time with blanks between them, told apart by the tokens that end a word.

    That holds for words of letters below U+0180, which the normaliser changes in case only; all other parts go to the library one by one.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
        split = ((told["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        if (steps, split, told["model"].get("end_of_word_suffix")) != (["NFC", "Replace", "Lowercase"], _SPLIT, "</w>"):
            raise ValueError(f"{path} cuts texts by rules that aren't known here")
        self.merges = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(told["model"]["merges"])}
        self.names, self.longest = told["model"]["vocab"], max(map(len, told["model"]["vocab"]))
        self.fits: dict[tuple, bool] = {}
        self.tokenizer = _library(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, i in vocabulary.items():
            self.ends[i] = piece.endswith("</w>")

    def plain(self, keys: list[str]) -> list[bytes]:
        out = []
        for start in range(0, len(keys), 2000):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(keys[start : start + 2000], add_special_tokens=False)]
        return out

    def merged(self, symbols: list[str]) -> list[str]:
        """Symbols after all merges, the one of lowest rank first, from left to right."""
        while len(symbols) > 1:
            rank, at = min((self.merges.get(pair, len(self.merges)), i) for i, pair in enumerate(zip(symbols[:-1], symbols[1:], strict=True)))
            if rank == len(self.merges):
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def _follows(self, before: str, token: str, end: str) -> bool:
        """Whether token (and end, the mark of a word's end) comes behind another one: merging both together gives just them."""
        key = (before, token, end)
        if key not in self.fits:
            if len(self.fits) > 200_000:
                self.fits.clear()
            symbols = [*before, *token[:-1], token[-1] + end]
            self.fits[key] = self.merged(symbols) == [x for x in (before, token + end) if x]
        return self.fits[key]

    def prefix_counts(self, word: str) -> np.ndarray:
        """Tokens of each prefix of a pretoken of byte symbols, if it ended there.

        Dynamic program: the tokens of a prefix are those of a shorter one and a last token, and that is the only
        one of the vocabulary that can follow its last token. First for prefixes that go on, then for those that end a word.
        """
        last, count = [""] * (len(word) + 1), np.zeros(len(word) + 1, np.int64)

        def tail(j: int, end: str) -> tuple[int, str]:
            for k in range(max(0, j - self.longest), j):
                token = word[k:j]
                if token + end in self.names and (k == 0 or last[k]) and self._follows(last[k], token, end):
                    return k, token
            raise ValueError("no token ends here")

        out = np.zeros(len(word), np.int64)
        for j in range(1, len(word) + 1):
            k, _ = tail(j, "</w>")
            out[j - 1] = count[k] + 1
            k, last[j] = tail(j, "")
            count[j] = count[k] + 1
        return out

    def __call__(self, parts: list[bytes]) -> list[bytes]:
        texts = b"\n".join(parts).decode("utf-8", "replace").split("\n")
        many = [i for i, t in enumerate(texts) if t.isalpha() and (t.isascii() or _PLAIN.fullmatch(t))]
        out: list[bytes | None] = [None] * len(parts)
        groups = [many[k : k + 500] for k in range(0, len(many), 500)]
        for some, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(cuts) == len(some):
                data, at = ids.tobytes(), 0
                for i, cut in zip(some, cuts, strict=True):
                    out[i], at = data[at:cut], cut
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.plain([texts[i] for i in rest]), strict=True):
            out[i] = x
        return out


#: Letters that the normaliser changes in case only.
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0100-\u012f\u0134-\u0148\u014a-\u017e]+")


def _encoder(path: str) -> Encoder:
    if ("encoder", path) not in _LOADED:
        _LOADED["encoder", path] = Encoder(path)
    return _LOADED["encoder", path]


def chunk_ids(path: str) -> Memo:
    """Part of a text to its identifiers as little-endian unsigned 32-bit integers; one memo for each process."""
    if ("ids", path) not in _LOADED:
        _LOADED["ids", path] = Memo(_encoder(path), entry=130)
    return _LOADED["ids", path]


class Encoded:
    """Identifiers of several texts side by side: ``ids``, ``ends`` behind each text, and ``n`` of each word."""

    def __init__(self, texts: pa.Array | list[bytes], path: str, with_ids: bool = True):
        self.parts = parts = Pretokens(texts)
        found = chunk_ids(path).values_of(parts.distinct.to_pylist())
        table, places = flat(found)
        sizes = (np.diff(places) // 4)[parts.at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        self.ends = total[parts.before[1:]]
        self.n = np.diff(total[np.append(parts.word_first, len(parts.at))])
        if with_ids:
            self.ids = np.frombuffer(table.tobytes(), "<u4")[ragged((places // 4)[parts.at], sizes)]


def encode_texts(texts: pa.Array | list[bytes], path: str) -> Encoded:
    """Identifiers of texts, each distinct part looked up once."""
    return Encoded(texts, path)


class PrefixTable:
    """Exact token counts of the prefixes of one text, as rows that can be stored: ``ends`` (bytes) and ``counts``.

    The dynamic program runs over the chunks: ``counts[i] = counts[i - 1] + tokens(chunk i)``, which is exact
    for each prefix that ends behind chunk i, or in the white space behind it. A prefix that ends inside a
    chunk takes the entry before it and a table of that one chunk, made once: for each character of the chunk the tokens of
    the chunk cut there. The text is never encoded again. Only where the library changes the letters of a pretoken of more than TABULATED
    characters as a whole (combining marks, final sigma) are no counts stored inside it: ``count`` encodes what the cut leaves of it, ``fit`` stops in front of it.
    """

    def __init__(self, text: bytes, path: str):
        self.text, self.path = text, path
        data, places = flat([text])
        self.starts, self.ends, _ = word_spans(data, places)
        self.counts = np.cumsum(Encoded([text], path, with_ids=False).n)
        self.inside: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @property
    def total(self) -> int:
        return int(self.counts[-1]) if len(self.counts) else 0

    def _cuts(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Of chunk i the bytes behind each character, and the tokens up to there."""
        if i not in self.inside:
            chunk = self.text[self.starts[i] : self.ends[i]]
            self.inside[i] = cut_counts(chunk, self.path)
        return self.inside[i]

    def count(self, n_bytes: int) -> int:
        """Tokens of the first ``n_bytes`` bytes, which must end at a character."""
        i = int(np.searchsorted(self.ends, n_bytes, "right"))
        n = int(self.counts[i - 1]) if i else 0
        if i < len(self.starts) and self.starts[i] < n_bytes:
            ends, counts = self._cuts(i)
            inside = int(counts[np.searchsorted(ends, n_bytes - self.starts[i])])
            n += inside if inside >= 0 else len(_encoder(self.path).plain([self.text[self.starts[i] : n_bytes].decode()])[0]) // 4
        return n

    def fit(self, budget: int) -> int:
        """Length in bytes of the longest prefix with at most ``budget`` tokens, without white space at its end; it ends where a count is stored."""
        i = int(np.searchsorted(self.counts, budget, "right"))
        before, n = (int(self.ends[i - 1]), int(self.counts[i - 1])) if i else (0, 0)
        if i < len(self.starts):
            inside = _fit(self.text[self.starts[i] : self.ends[i]], budget - n, self.path)
            if inside:
                return int(self.starts[i]) + inside
        return before


def cut_counts(chunk: bytes, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes behind characters of a chunk, and the tokens of the chunk cut there; -1 inside a long pretoken whose letters change as a whole.

    Pretokens are encoded on their own, so the counts at their borders stay when the cut moves on, and only the pretoken that
    is cut counts anew: short ones by the library, long ones by ``Encoder.prefix_counts``.
    """
    encoder = _encoder(path)
    tokenizer = encoder.tokenizer
    text = chunk.decode("utf-8", "replace")
    ends = np.cumsum([len(c.encode()) for c in text])
    each = [tokenizer.normalizer.normalize_str(c) for c in text]
    whole = "Σ" in text or "<|" in text or tokenizer.normalizer.normalize_str(text) != "".join(each)
    places = np.cumsum([0, *map(len, each)])
    stops = [] if whole else np.searchsorted(places, [b for _, (_, b) in tokenizer.pre_tokenizer.pre_tokenize_str("".join(each))]).tolist()
    counts, base, start = np.full(len(text), -1, np.int64), 0, 0
    for stop in sorted({*stops, len(text)}):
        if stop - start > TABULATED and not whole:
            symbols = ["".join(_SYMBOL[b] for b in c.encode()) for c in each[start:stop]]
            counts[start:stop] = base + encoder.prefix_counts("".join(symbols))[np.cumsum([*map(len, symbols)]) - 1]
        else:
            cuts = [text[start:j] for j in (range(start + 1, stop + 1) if stop - start <= TABULATED else [stop])]
            counts[stop - len(cuts) : stop] = [base + len(e.ids) for e in tokenizer.encode_batch_fast(cuts, add_special_tokens=False)]
        base, start = int(counts[stop - 1]), stop
    return ends, counts


def _fit(chunk: bytes, budget: int, path: str) -> int:
    """Bytes of the longest prefix of a chunk with at most ``budget`` tokens, where counts are stored."""
    ends, counts = cut_counts(chunk, path)
    some = np.flatnonzero((counts >= 0) & (counts <= budget))
    return int(ends[some[-1]]) if len(some) else 0


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", store: bool = False) -> DataFrame:
    """Token counts of whole texts by prefix dynamic programming.

    A row for each row: the identifier (as it is, null and repeats too), n_bytes (UTF-8), n_tokens,
    over_limit (n_tokens > limit), n_chunks, fit_chunks (the most leading chunks within the limit, from
    the prefix counts) and fit_bytes (bytes of the longest prefix within the limit, inside a chunk too; n_bytes for a whole text). With ``store`` also ends and counts: byte offset behind each chunk and tokens up to
    there. Null and empty texts have no tokens. Narrow: no shuffle, memory for a slice of about a megabyte or the longest text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, n_chunks long, fit_chunks long, fit_bytes long" + ", ends array<long>, counts array<long>" * store

    def run(batches):
        for b in slices(batches):
            coded = Encoded(b.column(1), path, with_ids=False)
            parts, before = coded.parts, coded.parts.words_before
            total = np.concatenate([[0], np.cumsum(coded.n)])
            n = total[before[1:]] - total[before[:-1]]
            fits = np.searchsorted(total, total[before[:-1]] + limit, "right") - 1
            fits = np.minimum(fits, before[1:]) - before[:-1]
            fit_bytes = parts.n_bytes.copy()
            for i in np.flatnonzero(n > limit).tolist():
                c = int(before[i] + fits[i])
                text, low = b.column(1)[i].as_py().encode(), int(parts.ends[c - 1] - parts.places[i]) if fits[i] else 0
                chunk = text[low : int(parts.ends[c] - parts.places[i])]
                blank = len(chunk) - len(chunk.lstrip(b" \t\n\v\f\r"))
                inside = _fit(chunk[blank:], int(limit - (total[c] - total[before[i]])), path)
                fit_bytes[i] = low + (blank + inside if inside else 0)
            out = [b.column(0), *map(pa.array, (parts.n_bytes, n, n > limit, np.diff(before), fits, fit_bytes))]
            if store:
                spans = pa.array(before, pa.int32())
                out += [pa.ListArray.from_arrays(spans, pa.array(parts.ends - np.repeat(parts.places[:-1], np.diff(before)))), pa.ListArray.from_arrays(spans, pa.array(total[1:] - np.repeat(total[before[:-1]], np.diff(before))))]
            yield pa.RecordBatch.from_arrays(out, names=[id_col, "n_bytes", "n_tokens", "over_limit", "n_chunks", "fit_chunks", "fit_bytes", *["ends", "counts"] * store])

    return docs.select(id_col, text_col).mapInArrow(run, schema)

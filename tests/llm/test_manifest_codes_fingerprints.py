"""Merkle manifest, I-Match fingerprints and vector codes against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import lexicons, merkle, vectorcodes
from locusframe.llm.common import Steps

DOC = "doc_id long, source string, lang string, n_chars long, text string, leaf string, path int, _g string, p1 string"


def table(spark, n, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = r.choice([None, "", "a", "b", "é", "hot", "hot", "hot"])
        text = r.choice([None, "", "x\ny\n", f"t{i}\nz", "plain", "w " * 40])
        rows.append((i if i % 17 else None, source, r.choice([None, "en"]), r.choice([None, i]), text, "l", 1, "g", "p"))
    return rows + rows[:3]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(level):
    """Root, and for each node its ways: a list of (run, place) from the lowest level up."""
    ways, at, level = [[] for _ in level], list(range(len(level))), list(level)
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for w, i in zip(ways, at, strict=True):
            w.append((runs[i // 3], i % 3))
        at, level = [i // 3 for i in at], [h(*run) for run in runs]
    return level[0], ways


def manifest_by_hand(rows):
    groups = defaultdict(list)
    for i, source, lang, n, text, *_ in rows:
        leaf = lambda t, v=(i, source, lang, n): h(*map(field, v), field(t))
        changed = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        groups[source].append((i is not None, i or 0, leaf(text), leaf(text.replace("\n", "")) if changed and text is not None else leaf(text), i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in order}
    root, upper = tree([trees[s][0] for s in order])
    out = []
    for s, over in zip(order, upper, strict=True):
        for x, way in zip(sorted(groups[s]), trees[s][1], strict=True):
            way, acc = way + over, x[3]
            for run, k in way:
                acc = h(*run[:k], acc, *run[k + 1 :])
            out.append((x[4], x[2], trees[s][0], root, h(*["".join(run[:k] + run[k + 1 :]) for run, k in way]), acc, acc == root))
    return Counter(out)


@pytest.mark.parametrize("n", [1, 2, 26, 700])
def test_manifest(spark, n):
    rows = table(spark, n, n)
    got = merkle.document_manifest(spark.createDataFrame(rows, DOC).repartition(3))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = manifest_by_hand(rows)
    assert Counter(map(tuple, got.collect())) == want
    assert n < 26 or {k[-1] for k in want} == {True, False}


def test_manifest_of_one_and_of_none(spark):
    one = spark.createDataFrame([(5, "a", "en", 1, "x", "", 0, "", "")], DOC)
    r = merkle.document_manifest(one).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == h("") and r.verified
    assert merkle.document_manifest(one.limit(0)).count() == 0


def test_manifest_when_groups_are_joined(spark, monkeypatch):
    monkeypatch.setattr(merkle, "MOST_GROUPS", 0)
    rows = table(spark, 100, 5)
    assert Counter(map(tuple, merkle.document_manifest(spark.createDataFrame(rows, DOC)).collect())) == manifest_by_hand(rows)


def test_numbers_of_repeated_rows(spark):
    rows = [("a", 1)] * 500 + [("b", k % 7) for k in range(100)]
    got = merkle.numbered(spark.createDataFrame(rows, "k string, v long").repartition(6), Steps(spark), "k", ["v"], "numbers").collect()
    by = defaultdict(list)
    for r in got:
        by[r.k].append((r["_at"], r.v, r["_n"]))
    assert all([x[0] for x in sorted(some)] == list(range(len(some))) and {x[2] for x in some} == {len(some)} for some in by.values())
    assert [x[1] for x in sorted(by["b"])] == sorted(k % 7 for k in range(100))


def codes_by_hand(rows):
    """Full search with Python's integers."""
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2]))
    w = len(kept[0][2]) // 4
    parts = lambda v: [v[p * w : (p + 1) * w] for p in range(4)]
    books = [[parts(r[2])[p] for r in kept[:256]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(4):
        met = [defaultdict(list) for _ in range(4)]
        for r in kept:
            for p, x in enumerate(parts(r[2])):
                met[p][near(p, x)[1]].append(x)
        for p in range(4):
            for k, some in met[p].items():
                books[p][k] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, label, [near(p, x) for p, x in enumerate(parts(v))]) for i, label, v in kept]
    sums = Counter()
    for _, label, f in found:
        sums[label] += sum(d for d, _ in f)
    return Counter((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), sums[label], sha) for i, label, f in found)


VECTOR = "vec_id long, embedding array<float>, label int, code string, v int, part int"


def vectors(n, seed, dim=8):
    r = random.Random(seed)
    rows = [(i, [r.choice([r.gauss(0, 0.2), 0.25, -0.0004]) for _ in range(dim)], r.choice([None, 1, 2, 2, 2])) for i in range(n)]
    bad = [(-1, None, 1), (-2, [0.1, None, *[0.0] * (dim - 2)], 1), (-3, [float("nan")] * dim, 1), (-4, [float("inf")] * dim, None)]
    return [np.float32(0).item() if False else (i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in [*rows, *bad, *rows[:5], (None, [0.5] * dim, 3)]]


@pytest.mark.parametrize(("n", "most"), [(40, 100_000), (700, 100_000), (700, 0)])
def test_vector_codes(spark, monkeypatch, n, most):
    monkeypatch.setattr(vectorcodes, "MOST_LABELS", most)
    rows = vectors(n, n)
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], VECTOR).repartition(3)
    got = vectorcodes.vector_codes(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == codes_by_hand(rows)


def test_vector_codes_without_vectors_and_of_odd_ones(spark):
    assert vectorcodes.vector_codes(spark.createDataFrame([], VECTOR)).count() == 0
    assert vectorcodes.vector_codes(spark.createDataFrame([(1, None, 1, "c", 1, 2)], VECTOR)).count() == 0
    for odd in ([0.1, 0.2, 0.3], [3e7] * 4):
        with pytest.raises(Exception, match="multiple of 4|too large"):
            vectorcodes.vector_codes(spark.createDataFrame([(1, odd, 1, "c", 1, 2)], VECTOR))


def test_exponion_looks_at_few_entries():
    """Clustered entries: the result is that of a full search, with a part of its distances."""
    r = np.random.default_rng(3)
    centres = r.integers(-1000, 1000, (16, 6))
    book = np.concatenate([c + r.integers(-20, 20, (16, 6)) for c in centres])
    x = book[r.integers(0, 256, 4000)] + r.integers(-5, 5, (4000, 6))
    apart = ((x[:, None].astype(np.int64) - book[None]) ** 2).sum(2)
    start = np.where(r.random(4000) < 0.9, apart.argmin(1), r.integers(0, 256, 4000))
    code, best, seen = vectorcodes.Exponion(book)(x, start)
    assert (code == apart.argmin(1)).all() and (best == apart.min(1)).all() and seen < 0.3 * 4000 * 256


TEXT = "doc_id long, text string, _text string, fingerprint string, _row int, path string"


def prose(r, n):
    return " ".join(r.choice(["River", "stone", "naïve", "ÉTÉ", "lamp", "road", "中文"]) + str(int(r.expovariate(0.05))) for _ in range(n))


def test_fingerprints(spark):
    r = random.Random(1)
    texts = [None, "", "...", "😀é", *[prose(r, r.choice([3, 30, 300])) for _ in range(60)], prose(r, 9000), "unheard-of quince"]
    texts += texts[10:13]
    rows = [(i if i != 8 else None, t, "a", "b", 3, "c") for i, t in enumerate(texts)] + [(5, texts[5], "a", "b", 3, "c"), (5, texts[9], "a", "b", 3, "c")]
    got = lexicons.match_fingerprints(spark.createDataFrame(rows, TEXT).repartition(3))
    assert got.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = got.collect()

    cut = lambda t: sorted({w for w in re.split(r"[\W_]+", (t or "").lower()) if w})
    df = Counter(w for row in rows for w in cut(row[1]))
    n, low, high = len(rows), *lexicons.BAND
    share = lambda w: math.log(n / df[w]) / math.log(n)
    held = lambda t: [w for w in cut(t) if df[w] and low <= share(w) <= high]
    every = sorted({w for row in rows for w in cut(row[1])})
    number = {x.w: x.h for x in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("h")).collect()}

    def subsets(t):
        """Distinct terms of each subset of each lexicon."""
        out = defaultdict(set)
        for w in held(t):
            for k in range(lexicons.LEXICONS):
                if number[w] & (4**k - 1) == 0:
                    out[k, (number[w] & (2**64 - 1)) >> 59].add(w)
        return out

    def near(a, b):
        if a == b:
            return None
        x, y, told = subsets(a), subsets(b), 0.0
        for k in range(lexicons.LEXICONS):
            places = {p for p in {*x, *y} if p[0] == k}
            if len(places) >= (lexicons.SUBSETS // 2 if k else 1):
                told = sum(x.get(p) == y.get(p) for p in places) / len(places)
        return told

    order = sorted(((row[0] is not None, row[0] or 0, row[1] or "") for row in rows), key=lambda x: x[:2])
    ids = Counter(x[:2] for x in order)
    of = {x[:2]: x[2] for x in order}
    keys = list(dict.fromkeys(x[:2] for x in order))
    for g in got:
        key = (g.doc_id is not None, g.doc_id or 0)
        after = keys[keys.index(key) - 1]
        if ids[key] > 1 or ids[after] > 1:
            continue
        t, other = of[key], of[after]
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        assert (g.n_chars, g.edited_sha256) == (len(t), h(edited))
        for mine, fp in ((t, g.fingerprint), (edited, g.edited_fingerprint)):
            assert {(int(fp[i]), lexicons._NAMES.index(fp[i + 1])) for i in range(0, len(fp), 6)} == subsets(mine).keys() if held(mine) else re.fullmatch("z[0-9a-f]{5}", fp)
        for b, told in ((edited, g.near_edited), (other, g.near_next)):
            assert told == (near(t, b) if held(t) or held(b) else float(cut(t) == cut(b))) or near(t, b) is None and told == 1.0 or subsets(t) == subsets(b) and told == 1.0
    same = defaultdict(set)
    for g, t in ((g, of[g.doc_id is not None, g.doc_id or 0]) for g in got if ids[g.doc_id is not None, g.doc_id or 0] == 1):
        same[t].add(g.fingerprint)
    assert all(len(some) == 1 for some in same.values())
    assert len({fp for some in same.values() for fp in some}) >= len({" ".join(cut(t)) for t in same}) - 1
    assert len(got) == len(rows) and np.mean([g.near_edited for g in got]) > np.mean([g.near_next for g in got]) + 0.15


def test_fingerprints_with_a_joined_lexicon_and_of_few_documents(spark, monkeypatch):
    r = random.Random(2)
    df = spark.createDataFrame([(i, prose(r, 50), "a", "b", 3, "c") for i in range(30)], TEXT)
    want = Counter(map(tuple, lexicons.match_fingerprints(df).collect()))
    monkeypatch.setattr(lexicons, "MOST_TERMS", 0)
    assert Counter(map(tuple, lexicons.match_fingerprints(df).collect())) == want
    one = lexicons.match_fingerprints(df.limit(1)).first()
    assert one.near_next == 1.0 and one.edited_sha256 != ""
    assert lexicons.match_fingerprints(df.limit(0)).count() == 0

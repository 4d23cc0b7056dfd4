"""The operators against brute force on awkward tables: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from locusframe.llm import language, leaks, lines, neardup, quality, rules, segments, sstable, tokens, warc

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, h string, w int, n string, node string, _id int, key string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "old", "river", "stone", "walks", "under", "bright", "cold", "lamp", "road"]) + str(r.randrange(40)) for _ in range(n))


TEXTS = [None, "", " \n\t ", "one", "One ONE one", prose(1, 60), prose(1, 60), prose(1, 60) + " extra", prose(2, 3000), "x # y\n$ z\nx # y\n\n" * 9, "naïve café 😀 ﬁn   é", "<|endoftext|> a <|startoftext|> b", "a b c d e f g h " * 3, "z" * 30000, prose(3, 8), prose(3, 3)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "en", "q", 1, "n", "m", 2, "k") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_op1_measures(docs, empty):
    for r in rules.quality_rules(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        t, w = r.text or "", words(r.text)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        held = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(held) - len(set(held)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert rules.quality_rules(docs).count() == docs.count()
    assert rules.quality_rules(empty).count() == 0


def test_op1_columns(docs):
    assert rules.quality_rules(docs).columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_op1_expectation_maximisation(spark):
    """Accuracies and posterior against the same rounds in plain Python, and against the truth that made the votes."""
    r, names = random.Random(4), ["a", "b", "c", "d"]
    truth = {"a": (0.95, 0.8), "b": (0.9, 0.7), "c": (0.97, 0.6), "d": (0.85, 0.9)}
    rows = []
    for _ in range(3000):
        good = r.random() < 0.7
        rows.append((good, [0 if r.random() < 0.2 else (1 if good else -1) * (1 if r.random() < truth[k][0 if good else 1] else -1) for k in names]))
    counted = Counter(tuple(v) for _, v in rows)
    got = rules.fit_accuracies(spark.createDataFrame([(*v, n) for v, n in counted.items()], "a int, b int, c int, d int, n long"), names)

    prior, g, b = 0.8, [0.999] * 4, [0.3] * 4
    post = lambda v: 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + sum(np.log(g[k] / (1 - b[k])) if x == 1 else np.log((1 - g[k]) / b[k]) if x == -1 else 0 for k, x in enumerate(v)))))
    for _ in range(30):
        p = {v: post(v) for v in counted}
        share = lambda k, c, w: (sum(n * w(v) for v, n in counted.items() if v[k] == c) + 0.5) / (sum(n * w(v) for v, n in counted.items() if v[k]) + 1)
        new = [min(0.9999, max(0.5, share(k, 1, p.get))) for k in range(4)]
        bad = [min(0.9999, max(1.02 * (1 - new[k]), share(k, -1, lambda v: 1 - p[v]))) for k in range(4)]
        prior, g, b = min(0.99, max(0.01, sum(n * p[v] for v, n in counted.items()) / len(rows))), new, bad
    assert np.allclose([got["prior"], *got["good"].values(), *got["bad"].values()], [prior, *g, *b], atol=1e-9)
    assert abs(got["prior"] - 0.7) < 0.05 and all(abs(got["good"][k] - truth[k][0]) < 0.06 and abs(got["bad"][k] - truth[k][1]) < 0.12 for k in names)
    one = spark.createDataFrame([(1, 0, -1, 1)], "a int, b int, c int, d int").select(rules.posterior(got)).first()[0]
    assert abs(one - post((1, 0, -1, 1))) < 1e-9


def test_op2_and_op3(docs, empty):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(WORD_BPE)
    encode = lambda t: tk.encode(t or "", add_special_tokens=False).ids
    got = sorted(sstable.token_shards(docs, WORD_BPE).collect(), key=lambda r: r.start)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (i, t) in zip(got, rows, strict=True):
        ids = [*encode(t), 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    counted = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, WORD_BPE).collect())
    assert counted == Counter((i, len((t or "").encode()), len(encode(t)), len(encode(t)) > 2048) for i, t in rows)
    text = TEXTS[10].encode()
    table = tokens.PrefixTable(text, WORD_BPE)
    for n in range(len(text) + 1):
        if n == len(text) or text[n] & 0xC0 != 0x80:
            assert table.count(n) == len(encode(text[:n].decode()))
    assert sstable.token_shards(empty, WORD_BPE).count() == tokens.count_tokens(empty, WORD_BPE).count() == 0


def test_op2_encoder_is_the_library(monkeypatch):
    from tokenizers import Tokenizer

    tk, r = Tokenizer.from_file(WORD_BPE), random.Random(8)
    alphabet = [*"abcXYZ'.,;<|>-_12 3\n\t!«»é×÷ÀžİĳſŉΣσ中文²½Ⅷ\u0301 ﬁß€", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "don't", "x'd", "the ", " 'tis"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(14))) for _ in range(6000)]
    texts += [t.replace("<|", "<-") for t in texts]
    for at in range(0, len(texts), 500):
        some = [t.encode() for t in texts[at : at + 500]]
        got = tokens.encode_texts(some, WORD_BPE)
        ends = [0, *got.ends.tolist()]
        assert [got.ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [e.ids for e in tk.encode_batch([t.decode() for t in some], add_special_tokens=False)]
        assert got.n.tolist() == [len(tk.encode(w, add_special_tokens=False).ids) for t in some for w in words(t.decode())]


def test_op3_budget():
    for text in (TEXTS[10], "中文" * 30, "abc,def.ghi " * 4, "z" * 700 + " b c"):
        table = tokens.PrefixTable(text.encode(), WORD_BPE)
        for budget in (0, 1, 2, 5, 9):
            n = table.fit(budget)
            assert table.count(n) <= budget and n <= len(text.encode())
    table = tokens.PrefixTable(b"ab,cd", WORD_BPE)
    counts = [table.count(n) for n in range(6)]
    assert [table.fit(b) for b in range(5)] == [max(n for n in range(6) if counts[n] <= b) for b in range(5)]


def test_op2_lookup():
    writer = sstable.ShardWriter()
    data = b""
    for i in range(-50, 3000):
        got = writer.add(sstable.key_of(i), np.arange(abs(i) % 70).astype("<u2").tobytes())
        data += got + b"\n" if got else b""
    data += b"".join(x + b"\n" for x in writer.finish())
    shard = sstable.Shard(data)
    for i in (-50, 0, 1, 2999):
        assert [x.tolist() for x in shard.lookup(i)] == [list(range(abs(i) % 70))]
    assert shard.lookup(5000) == []


def test_op4_line_dedup(docs, empty, spark):
    run = "\n".join(prose(10 + i, 20) for i in range(4))
    rows = [(1, "a1\n" + run + "\nb1"), (2, "c1\n" + run + "\nd1"), (3, run + "\n" + "only here\n" + run), (4, prose(9, 30)), (4, prose(9, 30)), (5, prose(10, 20)), (None, None)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, rows[0][1]), (2, "c1\nd1"), (3, "only here"), (4, rows[3][1]), (4, rows[3][1]), (5, rows[5][1]), (None, None)])
    out = lines.dedup_lines(docs)
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    assert lines.dedup_lines(empty).count() == 0


def test_op4_passages_cut_by_lines(spark):
    run = prose(30, 60).split()
    broken = " ".join(run[:7]) + "\n" + " ".join(run[7:40]) + "\n" + " ".join(run[40:])
    rows = [(1, "a1 a2 " + broken + " b1\nb2"), (2, "c1\nc2 " + broken + " d1\nd2"), (3, "e1  " + " ".join(run[5:56]) + "\tf1"), (4, "k d " + " ".join(run[5:54]) + " d k"), (5, "  " + broken + "\n\n d k")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (4, 0, rows[0][1]), 2: (5, 3, "c1\nc2\nd1\nd2"), 3: (1, 1, "e1  f1"), 4: (1, 0, rows[3][1]), 5: (4, 3, " d k")}


@pytest.mark.parametrize("min_words", [20, 50])
def test_op4_against_brute_force(spark, min_words):
    r = random.Random(5)
    parts = [[f"w{r.randrange(30)}" for _ in range(r.randrange(5, 40))] for _ in range(8)]
    texts = ["".join(w + r.choice([" ", " ", "\n"]) for w in sum((r.choice(parts) for _ in range(r.randrange(0, 7))), [])) for _ in range(60)]
    texts += [" ".join(f"p{i % period}" for i in range(n)) for period, n in ((1, 90), (3, 60), (7, 130), (40, 150), (60, 200))]
    seen: set[tuple] = set()
    want = []
    for t in texts:
        w = words(t)
        gone = set()
        for j in range(len(w) - min_words + 1):
            x = tuple(w[j : j + min_words])
            if x in seen:
                gone |= set(range(j, j + min_words))
            seen.add(x)
        want.append([x for j, x in enumerate(w) if j not in gone])
    out = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), min_words=min_words).orderBy("doc_id").collect()
    assert [words(r.text) for r in out] == want
    assert any(len(words(r.text)) < len(words(t)) for r, t in zip(out, texts, strict=True))


def test_op4_overlapping_spans_and_awkward_words(spark):
    run = [f"{x}{i}" for i, x in enumerate(["$1", "\\", "k", "d", "é", " ", "$0", "中"] * 13)][:100]
    gaps = ["\t", "\x0b", "\f", "\r", "\n", " ", "  ", "\n\n"]

    def text(words_, start):
        return "".join(w + gaps[(start + i) % len(gaps)] for i, w in enumerate(words_))

    rows = [(1, text(run[:60], 0)), (2, text(run[30:], 3)), (3, "k d " + text(run, 5) + "d k"), (4, text(run[30:60], 1)), (5, text(["k", "$0"] + run[11:60], 2) + text(run[:9], 0)), (6, " ".join(run[:60] + ["x"] + run[30:]))]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].text == rows[i - 1][1] and got[i].n_removed == 0 for i in (1, 2, 4, 5))
    assert words(got[3].text) == ["k", "d", "d", "k"] and words(got[6].text) == ["x"]


def test_op4_texts_without_partners_are_not_shuffled(spark):
    rows = [(i, prose(1000 + i, 60)) for i in range(300)] + [(300, prose(1007, 60)), (301, prose(5, 60) + " " + prose(1011, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lines.repeated_passages(docs)
    near = lines._among(docs.selectExpr("doc_id", "xxhash64(text) h"), "h", found, "maybe").filter("maybe").collect()
    # 7 has the text of 300, and bits go by text
    assert {r.doc_id for r in near} == {7, 300, 301}
    plan = lines.dedup_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and {r.doc_id for r in lines.dedup_lines(docs).filter("n_removed > 0").collect()} == {300, 301}


def test_op4_bits_of_every_slot(spark):
    edge = [0, 1, 7, 8, 32767, 32768, lines.SLOTS - 1, lines.SLOTS, -1, -8, -(1 << 63), (1 << 63) - 1]
    keys = spark.createDataFrame([(x,) for x in edge], "h long")
    others = {(x + d) for x in edge for d in (-2, 2, 5)} - {(x + lines.SLOTS * m) for x in edge for m in (-1, 0, 1)}
    others = {x for x in others if -(1 << 63) <= x < 1 << 63 and x % lines.SLOTS not in {y % lines.SLOTS for y in edge}}
    got = {r.h: r.maybe for r in lines._among(spark.createDataFrame([(x,) for x in [*edge, *others]], "h long"), "h", keys, "maybe").collect()}
    assert got == {x: x in edge for x in [*edge, *others]}


@pytest.mark.parametrize("min_words", [1, 2, 5, 20, 50])
def test_op4_marks_hold_each_window_once(spark, min_words):
    r = random.Random(min_words)
    texts = [" ".join(f"p{r.randrange(v)}" for _ in range(n)) for v, n in ((1, 300), (2, 300), (50, 51), (3000, 50), (3000, 900))] + [" ".join(f"q{i % 40}" for i in range(400))]
    marks = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rules._let(lines._words(F.col("t")), lambda h: lines._marks(h, min_words)).alias("m"))
    chosen: dict[tuple, int] = {}
    for row in marks.collect():
        w = row.t.split(" ")
        assert sorted(x for m in row.m for x in range(m.s, m.e + 1)) == list(range(len(w) - min_words + 1))
        for m in row.m:
            assert all(chosen.setdefault(tuple(w[x : x + min_words]), m.a) == m.a for x in range(m.s, m.e + 1))
            # equal windows of one stretch are only where several places are counted
            assert m.places > 1 or len({tuple(w[x : x + min_words]) for x in range(m.s, m.e + 1)}) == m.e - m.s + 1


def test_op5_samples(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = segments.sampled_segmentations(docs, PIECES, k=4, with_ids=True).collect()
    texts = {(r.doc_id): r.text or "" for r in docs.collect()}
    by = defaultdict(set)
    for r in got:
        assert r.round_trip and 0 <= r.inclusion <= 1 and r.log_prob <= 1e-9
        by[r.doc_id].add(tuple(r.ids))
        if "  " not in texts[r.doc_id] and texts[r.doc_id].isascii() and texts[r.doc_id].strip() == texts[r.doc_id]:
            assert sp.decode(list(r.ids)) == texts[r.doc_id]
    assert {r.doc_id for r in got} == set(texts)
    for i in (5, 8):
        assert len(by[i]) == 4
    assert segments.sampled_segmentations(empty, PIECES).count() == 0


def segmentations(text, vocabulary, longest):
    if not text:
        yield ()
    for n in range(1, min(longest, len(text)) + 1):
        if text[:n] in vocabulary:
            for rest in segmentations(text[n:], vocabulary, longest):
                yield (vocabulary[text[:n]], *rest)


def test_op5_samples_follow_the_model():
    import pyarrow as pa

    model = segments.pieces(PIECES, segments.ALPHA)
    vocabulary = {model.blob[model.place[i] : model.place[i] + model.size[i]].tobytes(): i for i in model.named[model.named >= 0].tolist()}
    every = list(segmentations(b" abca", vocabulary, model.longest))
    weight = np.exp([sum(model.weight[i] for i in x) for x in every])
    p = dict(zip(every, weight / weight.sum(), strict=True))
    n, k = 6000, 3
    data, places = segments._with_blank(pa.array(["abca"] * n))
    found = segments.sample(data, places, np.arange(1, n + 1), k, model)
    ids = [tuple(x.tolist()) for x in found.ids]
    assert found.text == [d for d in range(n) for _ in range(k)]
    assert all(abs(np.exp(lp) - p[x]) < 1e-9 for lp, x in zip(found.log_prob, ids, strict=True))
    assert all(len(set(ids[k * d : k * d + k])) == k for d in range(n))
    second = {s: sum(p[a] * p[s] / (1 - p[a]) for a in every if a != s and p[a] < 1) for s in every}
    for place, want in ((0, p), (1, second)):
        counts = Counter(ids[place::k])
        assert all(abs(counts[s] / n - q) < 5 * (q * (1 - q) / n) ** 0.5 + 1e-3 for s, q in want.items())
    for s in every:  # each segmentation's weight by its inclusion score is one on average
        share = [np.exp(-li) for x, li in zip(ids, found.log_inclusion, strict=True) if x == s]
        if p[s] > 0.02:
            assert abs(sum(share) / n - 1) < 0.25


def test_op5_lattice_of_long_and_odd_texts():
    import pyarrow as pa

    model = segments.pieces(PIECES, segments.ALPHA)
    texts = ["z" * 30000, "a  b\n\n c", "\u4f60\U0001f600\u0001", " ", "\n", "é" * 50, "x" * 9 + " " * 40]
    data, places = segments._with_blank(pa.array(texts))
    found = segments.sample(data, places, np.arange(len(texts)), 2, model)
    for d, ids in zip(found.text, found.ids, strict=True):
        assert segments.decode(ids, model) == texts[d].encode()


def test_op6_leaks(docs, empty, spark):
    item = "what is the capital of the northern province and which river runs through its old harbour quarter"
    w = item.split()
    near = " ".join([*w[:5], "really", *w[5:]])
    rows = [(1, prose(20, 200) + " " + item + " " + prose(21, 50)), (2, near), (3, prose(22, 300)), (4, None), (5, ""), (6, item.upper() + "!")]
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (None, "x y z")], "item_id long, text string")
    got = leaks.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 7), (2, 7), (6, 7)}
    assert leaks.without_leaks(docs, bench).count() == docs.count()
    assert leaks.leaks(empty, bench).count() == 0
    assert leaks.leaks(docs, bench.limit(0)).count() == 0


def test_op6_case_and_short_items(spark, monkeypatch):
    item = "éai éonleeau pour an éonqueê straße où la rivière dépasse l'église grâce à un très vieux pont élevé"
    short = ["zanzibar copper lantern", "quokka velvet orbit thunder fjord", "mango pylon cactus ribbon saddle walnut"]
    rows = [(0, prose(40, 90) + " " + item.upper() + " " + prose(41, 20))]
    want = {(0, 0)}
    for k, x in enumerate(short):
        for shift in range(12):
            rows.append((100 * (k + 1) + shift, prose(shift, 40 + shift) + " " + x + " " + prose(shift + 50, 60)))
            want.add((rows[-1][0], k + 1))
    rows += [(i, prose(i, 80)) for i in range(1000, 1040)]
    bench = spark.createDataFrame(list(enumerate([item, *short])), "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(df, bench).collect()} == want
    index = leaks.fit_index(leaks.word_rows(df), bench)
    texts = leaks.word_ids([" ".join(t for _, t in rows).encode(), b"", rows[0][1].encode()])
    whole = index.search(texts)
    assert {(d, i) for d, i, *_ in whole} == {(0, 0), (0, 1), (0, 2), (0, 3), (2, 0)}
    monkeypatch.setattr(leaks, "BLOCKS", 16)
    assert [(d, i) for d, i, *_ in index.search(texts)] == [(d, i) for d, i, *_ in whole]


def test_op6_basis_of_all_documents(spark):
    texts = [f"w{i % 97} v{i % 89} u{i % 83}" for i in range(13_000)]
    bench = spark.createDataFrame([(1, "w1 v2 u3")], "item_id long, text string")
    index = leaks.fit_index(leaks.word_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)), bench)
    rows = leaks.word_ids([t.encode() for t in texts])
    df = np.bincount(np.concatenate([np.unique(r & (leaks.FEATURES - 1)) for r in rows]), minlength=leaks.FEATURES)
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1e-3).astype(np.float32)
    omega = np.random.default_rng(11).standard_normal((leaks.FEATURES, leaks.RANK + leaks.OVERSAMPLE)).astype(np.float32)
    want = leaks.basis(leaks.gram_sketch(rows, idf, omega).astype(np.float64), omega.astype(np.float64), leaks.RANK) * idf[:, None]
    assert np.allclose(index.map @ index.map.T[:, :600], want @ want.T[:, :600], atol=5e-2)


def test_op7_language(docs, empty, spark):
    say = {"en": "the house of a man with the dog and that", "fr": "la maison de le chien avec une femme et que", "de": "das haus und der hund mit einem mann ist"}
    rows = [(i, " ".join(random.Random(i).choices(say[k].split(), k=30)), k) for i, k in enumerate(list(say) * 40)]
    model = language.fit_languages(spark.createDataFrame([*rows, (900, None, "en"), (901, "x", None)], "doc_id long, text string, lang string"), PIECES)
    found = {r.doc_id: r for r in language.detect(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    assert all(found[i].lang_pred == k for i, _, k in rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in found.items())
    other = {r.doc_id: r.lang_pred for r in language.detect(docs, model).collect()}
    assert other[0] == other[1] == other[2] == "und" and other[5] != "und"
    assert language.detect(empty, model).count() == 0


def test_op7_sums_and_expectations_are_those_of_all_segmentations():
    vocabulary = language.vocabulary(PIECES)
    number = {p: i for i, p in enumerate(vocabulary.pieces)}
    table = np.random.default_rng(0).random((len(number) + 2, 2)) * 1e-3
    table[-1] = 0

    def every(word):
        if not word:
            yield (), np.ones(2)
        for n in range(1, len(word) + 1):
            piece = number.get(word[:n], len(number) if n == 1 else None)
            if piece is not None:
                for rest, p in every(word[n:]):
                    yield (piece, *rest), table[piece] * p

    words_ = ["house", "théâtre", "ab", "zq", "łódź", "international", "x"]
    model = language.Languages(["a", "b"], table, PIECES)
    assert np.allclose(model.words(words_), [np.log(sum(p for _, p in every(w))) for w in words_])
    uses, weight = np.zeros_like(table), np.arange(14.0).reshape(7, 2)
    for w, n in zip(words_, weight, strict=True):
        total = sum(p for _, p in every(w))
        for pieces, p in every(w):
            for piece in pieces:
                uses[piece] += n * p / total
    assert np.allclose(language.Lattice(words_, vocabulary).expected(table, weight), uses)
    assert np.isfinite(model.words(["z" * 5000])).all()


def test_op7_letters():
    chunks, found = language.letter_chunks(["Ab-c2D ²½Ⅷ é_É".encode(), b"", b"12"])
    assert [sum((found[i] for i in chunks.at[a:b]), []) for a, b in zip(chunks.before[:-1], chunks.before[1:], strict=True)] == [["ab", "c", "d", "é", "é"], [], []]


@pytest.mark.parametrize("name", ["op7_language", "op10_quality_classifier"])
def test_held_out_accuracy(spark, name):
    from locusframe.llm import queries

    data = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, data)
    if name == "op7_language":
        want = spark.read.parquet(f"{data}/documents.parquet").filter("lang is not null").select("doc_id", "lang")
        rows = got.filter("held_out and lang_pred <> 'und'").join(want, "doc_id").selectExpr("lang_pred = lang as ok").collect()
        assert len(rows) > 100 and sum(r.ok for r in rows) / len(rows) > 0.97
        return
    rows = got.filter("held_out").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").filter("quality is not null").select("score", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == y] for y in (1, 0))
    assert len(good) > 5 and len(bad) > 5
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.95


def test_op8_archive(spark):
    html = [None, "", "<p>a</p>", "<p>a</p>", "é\r\n\r\nWARC/1.1\r\n", "x" * 200000, "<p>a</p>"]
    pages = spark.createDataFrame([(i, f"http://h/{i}\n", x, "c") for i, x in enumerate(html)], "page_id long, url string, html string, sha string")
    got = {r.page_id: r for r in warc.page_archive(pages).collect()}
    most = {x or "": i for i, x in enumerate(html)}
    for i, x in enumerate(html):
        b, last = (x or "").encode(), most[x or ""]
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == last else ("revisit", last))
    assert warc.page_archive(pages.limit(0)).count() == 0
    rows = [(None, "a"), (None, "a"), (None, "z"), (5, "a"), (5, "a"), (7, None), (7, "")]
    got = warc.page_archive(spark.createDataFrame([(i, None, x) for i, x in rows], "page_id long, url string, html string")).select("page_id", "payload_bytes", "record_type", "refers_to").collect()
    want = [(None, 1, "revisit", 5)] * 2 + [(None, 1, "response", None)] + [(5, 1, "response", None)] * 2 + [(7, 0, "response", None)] * 2
    assert Counter(map(tuple, got)) == Counter(want)


def test_op8_random_damage():
    r = random.Random(3)
    parts = [warc.record(i, f"http://h/{i}", r.randbytes(r.randrange(400)), None) for i in range(200)]
    for archive in (b"".join(parts), b"".join(map(warc._member, parts))):
        data = bytearray(archive)
        for _ in range(20):
            data[r.randrange(len(data))] ^= 1 << r.randrange(8)
        found = list(warc.salvage(bytes(data)))
        good = {x[3]["warc-record-id"] for x in found if x[0] == "record"}
        assert len(good) >= 175 and all(x[4] in bytes(archive) or archive[:1] == b"\x1f" for x in found if x[0] == "record")
        spans = sorted({(x[1], x[2]) for x in found})
        assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_op8_salvage():
    parts = [warc.record(i, f"http://h/{i}", b"payload %d" % i, None) for i in range(4)]
    whole = b"".join(parts)
    assert [x[0] for x in warc.salvage(whole)] == ["record"] * 4
    cut = len(parts[0]) + len(parts[1]) - 30
    damaged = whole[:cut] + b"\x00junk" + whole[cut + 9 :]
    found = list(warc.salvage(damaged))
    assert [x[0] for x in found] == ["record", "gap", "record", "record"]
    assert sum(x[2] - x[1] for x in found) == len(damaged)
    assert [x[0] for x in warc.salvage(whole[:-10])] == ["record", "record", "record", "gap"]
    assert [x[0] for x in warc.salvage(warc.record(1, "data:" + "x" * 200_000, b"p", None))] == ["record"]
    one = gzip.compress(whole)
    assert [x[0] for x in warc.salvage(one[:-8] + b"\x00" * 8)] == ["gap", *["record"] * 4]
    assert [x[0] for x in warc.salvage(warc._member(parts[0]) + b"\x00\n" + warc._member(parts[1]))] == ["record", "gap", "record"]
    big = warc.record(1, "u", random.Random(0).randbytes(1 << 14) * 1100, None)
    assert warc._member(big)[-1] == 0 and [x[0] for x in warc.salvage(warc._member(big) + warc._member(parts[0]))] == ["record"] * 2
    members = [gzip.compress(p) for p in parts]
    members[1] = members[1][:-12] + b"\x00" * 12
    assert [x[0] for x in warc.salvage(b"".join(members))] == ["record", "gap", "record", "record"]


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("small", [16, 2])
def test_op9_components(spark, docs, empty, small, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK_SETS", small)
    rows, r = [], random.Random(5)
    for g in range(12):
        base = prose(100 + g, 80).split()
        for _ in range(6):
            for _ in range(r.choice([0, 0, 1, 2])):
                base[r.randrange(len(base))] = f"new{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(base)))
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A b"), (1004, "a")]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 4, 80)
    out = neardup.near_duplicates(docs)
    assert out.count() == docs.count()
    assert {x.doc_id for x in out.filter("not kept").collect()} >= {6, 7}
    assert neardup.near_duplicates(empty).count() == 0


def family(n, seed=1):
    """Texts of 120 words whose every tenth place has one of four words: alike, most of them less than the threshold."""
    base = prose(seed, 120).split()
    r = random.Random(seed)
    return [(i, " ".join(f"w{p}{r.randrange(4)}" if p % 10 == 0 else w for p, w in enumerate(base))) for i in range(n)]


def test_op9_families_that_collide(spark, monkeypatch):
    """One round, rows that grow with the sets and blocks of a group, and no link lost, with and without the bound on estimates."""
    made = []
    real = neardup._by_blocks

    def counted(rows, nodes, sets, percent):
        made.append((rows.count(), (out := real(rows, nodes, sets, percent)).count()))
        return out

    monkeypatch.setattr(neardup, "_by_blocks", counted)
    for n in (100, 400, 1600):
        rows = family(n)
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        if n < 1600:
            assert got == brute(rows, 4, 80)
        assert len({x[1] for x in got.values()}) > 10
    assert len(made) == 3 and all(links <= rows <= neardup.BANDS * n for (rows, links), n in zip(made, (100, 400, 1600), strict=True)), made
    monkeypatch.setattr(neardup, "DEVIATIONS", float("inf"))
    monkeypatch.setattr(neardup, "SMALL", 10**6)
    rows = family(100, 3)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows, 4, 80)


def test_op9_forest_has_every_component():
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 40, 60)
    sets = [np.unique(np.where(r.random(60) < r.choice([0.02, 0.1, 0.3]), r.integers(0, 1 << 40, 60), base)) for _ in range(120)]
    comps = np.arange(120)
    comps[:30] = 7
    left, right = np.arange(0, 70), np.arange(70, 120)
    for a, b in ((left, right), (np.arange(120), np.arange(120))):
        found = neardup.forest(sets, comps, a, b, 80)
        root = {c: c for c in comps}

        def top(c, root=root):
            return c if root[c] == c else top(root[c])

        for i, j in found:
            x, y = set(sets[i]), set(sets[j])
            assert 100 * len(x & y) >= 80 * len(x | y) and top(comps[i]) != top(comps[j])
            root[top(comps[i])] = top(comps[j])
        for i in a:
            for j in b:
                x, y = set(sets[i]), set(sets[j])
                assert 100 * len(x & y) < 80 * len(x | y) or top(comps[i]) == top(comps[j])


def test_op9_identifiers_that_are_text(spark):
    rows = [("a1", prose(1, 60)), ("a2", prose(1, 60) + " extra"), (None, prose(1, 60)), ("b", prose(2, 60)), (None, "")]
    got = Counter(tuple(x)[0:1] + (x.component_id, x.kept) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == Counter({("a1", "a1", True): 1, ("a2", "a1", False): 1, (None, "a1", False): 1, ("b", "b", True): 1, (None, None, True): 1})


def test_op2_and_op8_files_by_bytes(spark, tmp_path):
    """Large rows in one place: no file is much above its bound, and all rows come back in order."""
    import os

    sizes = lambda top: [os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names if f.startswith("part-")]
    r = random.Random(3)
    rows = [(i, f"u{i}", "x" * 20 if i < 3000 else "".join(r.choice("abcdefgh") for _ in range(60_000))) for i in range(3030)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    for gz in (False, True):
        warc.write_warc(pages, str(tmp_path / f"w{gz}"), gz, archive_bytes=200_000)
        assert max(sizes(tmp_path / f"w{gz}")) <= 1.5 * 200_000 and len(sizes(tmp_path / f"w{gz}")) > 4
        assert warc.read_warc(spark, str(tmp_path / f"w{gz}")).count() == 3030 and warc.quarantine(spark, str(tmp_path / f"w{gz}")).count() == 0
    docs = spark.createDataFrame([(i if i < 3000 else 5000, "a" if i < 3000 else prose(i, 3000)) for i in range(3030)], "doc_id long, text string").repartition(4)
    sstable.write_shards(docs, str(tmp_path / "s"), WORD_BPE, shard_bytes=30_000)
    assert max(sizes(tmp_path / "s")) <= 30_000 + 2 * sstable.BLOCK_BYTES
    got = sorted(sstable.read_shards(spark, str(tmp_path / "s")).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == [*range(3000), *[5000] * 30] and [x.start for x in got] == np.cumsum([0, *[x.n_tokens for x in got[:-1]]]).tolist()


def test_op6_many_blocks_and_repeated_documents(spark, monkeypatch):
    items = [(k, " ".join(f"q{k}x{j}" for j in range(12))) for k in range(8)]
    rows = [(i, prose(i, 40) + " " + items[i % 8][1]) for i in range(16)] + [(100 + i, prose(i, 60)) for i in range(20)]
    docs = spark.createDataFrame([*rows, rows[3], rows[3]], "doc_id long, text string").repartition(40)
    bench = spark.createDataFrame(items, "item_id long, text string")
    of = lambda: Counter((r.doc_id, r.item_id) for r in leaks.leaks(docs, bench).collect())
    want = Counter({(i, i % 8): 3 if i == 3 else 1 for i in range(16)})
    assert of() == want
    monkeypatch.setattr(leaks, "ITEM_BYTES", 100)
    monkeypatch.setattr(leaks, "SUMMED", 2)
    assert of() == want


def test_op6_recall_of_the_cosine(spark):
    """The cosine loses hardly any document that the subsequence and the answer alone would find in all windows."""
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "benchmark"))
    of = lambda **more: {(r.doc_id, r.item_id) for r in leaks.leaks(docs, items, **more).collect()}
    found, every = of(), of(cosine=-2.0)
    assert found <= every and len(found) >= 0.9 * len(every) > 10


def test_op3_counts_inside_long_stretches(spark):
    """Every prefix of texts without blanks by the library, and the longest one within a budget."""
    from tokenizers import Tokenizer

    tk, r = Tokenizer.from_file(WORD_BPE), random.Random(7)
    encode = lambda t: len(tk.encode(t, add_special_tokens=False).ids)
    texts = ["".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(420)), "z" * 700, "é" * 600, "".join(r.choice("etaoinshrdlu") for _ in range(500)), "ab1" + "Straße" * 60 + "!?" * 200 + "x's", "e\u0301" * 200]
    for t in texts:
        table = tokens.PrefixTable(t.encode(), WORD_BPE)
        want = [encode(t[:j]) for j in range(len(t) + 1)]
        assert [table.count(len(t[:j].encode())) for j in range(len(t) + 1)] == want
        if "\u0301" not in t:
            for budget in (1, 60, 200, want[-1] + 5):
                assert table.fit(budget) == len(t[: max(j for j, n in enumerate(want) if n <= budget)].encode())
    docs = spark.createDataFrame(list(enumerate(["go on  " + t for t in texts[:5]])), "doc_id long, text string")
    got = tokens.count_tokens(docs, WORD_BPE, limit=60).collect()
    for x in got:
        t = "go on  " + texts[x.doc_id]
        best = max(j for j in range(len(t) + 1) if encode(t[:j]) <= 60)
        assert x.fit_bytes == (len(t[:best].rstrip(" ").encode()) if x.over_limit else x.n_bytes)
    with pytest.raises(ValueError, match="rules"):
        tokens.PrefixTable(b"x", public_tokenizers.path("byte_bpe_50k.json"))


def test_op10_votes_are_those_of_all_products():
    texts = [(prose(i, 40) if i % 3 else "BUY $$ now !! " * (5 + i)).encode() for i in range(90)]
    voter = quality.Voter(texts[:60], [int(i % 3 > 0) for i in range(60)], 0.6)
    near = voter.embed(texts) @ voter.vectors.T
    for got, sims in zip(voter.scores(texts), near, strict=True):
        best = sorted(range(60), key=lambda j: -sims[j])[: voter.k]
        w = [max(float(sims[j]), 0) ** 4 * voter.weight[j] for j in best]
        assert abs(got - (sum(x for x, j in zip(w, best, strict=True) if voter.labels[j]) + 1e-3 * 0.6) / (sum(w) + 1e-3)) < 1e-3


def test_op10_string_identifiers_hot_rows_and_conflicting_labels(spark):
    rows = [("a" + str(i), prose(i, 60) if i % 2 else "$$ ## BUY now !!! " * 12) for i in range(80)] + [("a1", prose(1, 60))] * 50
    labels = spark.createDataFrame([("a" + str(i), i % 2) for i in range(80)] + [("a0", 1), ("a0", 1)], "doc_id string, quality int")
    voter = quality.fit_quality(spark.createDataFrame(rows, "doc_id string, text string"), labels, rows=30)
    assert len(voter.labels) <= 60 and 0 < voter.labels.mean() < 1
    got = {r.doc_id: r.predicted for r in quality.score_quality(spark.createDataFrame(rows, "doc_id string, text string"), voter).collect()}
    assert sum(got[f"a{i}"] == i % 2 for i in range(80)) > 74
    short = quality.fit_quality(spark.createDataFrame(rows, "doc_id string, text string"), labels, max_bytes=2 * 250)
    assert len(short.labels) >= 2


def test_op10_quality(docs, empty, spark):
    rows = [(i, prose(i, 60) if i % 2 else "$$ ## BUY now !!! " * 12) for i in range(120)]
    labels = spark.createDataFrame([*[(i, i % 2, 0) for i, _ in rows], (None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    voter = quality.fit_quality(df, labels)
    got = {r.doc_id: r for r in quality.score_quality(df, voter).collect()}
    assert all(got[i].predicted == i % 2 and 0 <= got[i].score <= 1 for i, _ in rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    exact = voter.embed([t.encode() for _, t in rows]) @ voter.vectors.T
    assert np.isfinite(exact).all()
    assert quality.score_quality(docs, voter).count() == docs.count()
    assert quality.score_quality(empty, voter).count() == 0
    none = quality.fit_quality(empty, labels.limit(0))
    assert quality.score_quality(docs, none).count() == docs.count()

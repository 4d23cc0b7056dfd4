"""Folds over chunks against the plain rules, row by row, on crowded places and with small chunks."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from locusframe.operators import cluster, intervals, places
from locusframe.steps import Steps

INDEL = "read_idx long, obs_idx int, chrom string, pos int, svtype string, length int, mapq int, rname string, seq string"
CLIP = "read_idx long, obs_idx int, chrom string, pos int, side string, cliplen int, mapq int, rname string"
SPLIT = "read_idx long, obs_idx int, chrom1 string, pos1 int, chrom2 string, pos2 int, mapq int, rname string, same_chrom boolean, note string"
EVENT = "ord long, chrom string, pos int, `end` int, svtype string, svlen int, read string, mapq int, support long"


def leaders(rows, window, positions, length=None):
    """Sizes of clusters by the first row that is left and all that match it."""
    rest, out = sorted(rows, key=lambda r: (*[r[p] for p in positions], r[length] if length else 0, r[0], r[1])), []
    while rest:
        lead = rest[0]
        same = lambda r, lead=lead: all(abs(r[p] - lead[p]) <= window for p in positions) and (not length or abs(r[length] - lead[length]) <= max(5, max(r[length], lead[length]) // 10))
        out.append(sorted(r[:2] for r in rest if same(r)))
        rest = [r for r in rest if not same(r)]
    return sorted(out)


def led(spark, rows, schema, keys, positions, window, length=None):
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = cluster.greedy_leaders(df, Steps(spark), keys, positions, window, length)
    assert got.columns == [*df.columns, "_leader"] or set(got.columns) == {*df.columns, "_leader"}
    groups = got.groupBy(*keys, "_leader").agg(F.collect_list(F.struct("read_idx", "obs_idx")).alias("m")).collect()
    return sorted(sorted(map(tuple, g.m)) for g in groups)


@pytest.fixture(params=[(1 << 20, 1 << 14), (50, 5)], ids=["usual", "small"])
def cut(request, monkeypatch):
    monkeypatch.setattr(places, "STRETCH", request.param[0])
    monkeypatch.setattr(cluster, "CHUNK", request.param[1])


@pytest.mark.parametrize("spread", [60, 400, 4000])
def test_leaders_of_all_kinds(spark, cut, spread):
    r = random.Random(spread)
    at = lambda: r.randrange(spread)
    clips = [(i, i % 3, "1", at(), "L", 30, 9, f"r{i}") for i in range(200)]
    assert led(spark, clips, CLIP, ["chrom", "side"], ["pos"], 7) == leaders(clips, 7, [3])
    indels = [(i, 0, "1", at(), "DEL", r.choice([20, 24, 40, 300, 320, 335]), 9, f"r{i}", None) for i in range(200)]
    assert led(spark, indels, INDEL, ["chrom", "svtype"], ["pos"], 7, "length") == leaders(indels, 7, [3], 5)
    splits = [(i, 0, "1", at(), "2", at() // 4, 9, f"r{i}", False, "n") for i in range(200)]
    assert led(spark, splits, SPLIT, ["chrom1", "chrom2"], ["pos1", "pos2"], 7) == leaders(splits, 7, [3, 5])


def test_positions_without_a_gap_settle_from_chunk_to_chunk(spark, monkeypatch):
    """Every base has a clip, so nothing ever synchronises and each chunk waits for the one before it."""
    monkeypatch.setattr(cluster, "CHUNK", 16)
    clips = [(i, 0, "1", 100 + i, "L", 30, 9, f"r{i}") for i in range(150)]
    got = led(spark, clips, CLIP, ["chrom", "side"], ["pos"], 10)
    assert got == sorted([(100 + i - 100, 0) for i in range(k, min(k + 11, 150))] for k in range(0, 150, 11))


def test_window_wider_than_chunks_and_stretches(spark, cut):
    r = random.Random(3)
    clips = [(i, 0, "1", r.randrange(900), "L", 30, 9, f"r{i}") for i in range(120)]
    assert led(spark, clips, CLIP, ["chrom", "side"], ["pos"], 130) == leaders(clips, 130, [3])


def open_groups(rows, window):
    """Sets of ord by the open group, a row at a time."""
    out, members = [], []
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        if not any(abs(r[2] - m[2]) <= window and abs(r[3] - m[3]) <= window for m in members):
            out.append([])
            members = []
        members.append(r)
        out[-1].append(r)
    return out


@pytest.mark.parametrize("spread", [30, 300, 3000])
def test_open_groups(spark, cut, spread):
    r = random.Random(spread)
    rows = [(i, "1", p, p + r.choice([0, 3, 30, 200]), "DEL", 5, f"r{i}", 9, r.choice([None, 1, 4])) for i in range(250) for p in [r.randrange(spread)]]
    got = cluster.sequential_merge(spark.createDataFrame(rows, EVENT).repartition(3), window=9, min_support=1)
    want = Counter()
    for g in open_groups(rows, 9):
        best = max(g, key=lambda x: x[8] or 1)
        want[best[2], best[3], sum(x[8] or 1 for x in g), len(g), ",".join(f"1:{x[2]}:{x[3]}" for x in g)] += 1
    assert Counter((x.pos, x.end, x.support, x.merged_count, x.read_positions) for x in got.collect()) == want


def test_deep_pile_is_many_tasks(spark, monkeypatch):
    """A third of a million rows without a gap: chunks of bounded size, the same groups as by the plain rule."""
    monkeypatch.setattr(cluster, "CHUNK", 1 << 12)
    seen = []
    real = cluster._settled
    monkeypatch.setattr(cluster, "_settled", lambda chunks, *more: seen.append(chunks.select(F.size("items").alias("n")).collect()) or real(chunks, *more))
    n = 120_000
    df = spark.range(n).select(F.col("id").alias("ord"), F.lit("1").alias("chrom"), F.floor(F.col("id") / 4).cast("int").alias("pos"), (F.floor(F.col("id") / 4) + F.col("id") % 3 * 40).cast("int").alias("end"), F.lit("DEL").alias("svtype"), F.lit(5).alias("svlen"), F.lit("r").alias("read"), F.lit(9).alias("mapq"), F.lit(1).cast("long").alias("support"))
    rows = [(i, "1", i // 4, i // 4 + i % 3 * 40, "DEL", 5, "r", 9, 1) for i in range(n)]
    got = cluster.sequential_merge(df, window=9, min_support=1).select("merged_count").collect()
    assert Counter(x[0] for x in got) == Counter(map(len, open_groups(rows, 9)))
    assert len(seen[0]) >= n // (1 << 12) and max(x.n for x in seen[0]) <= 1 << 12


def test_clip_clusters_need_no_python(spark):
    rows = [(i, 0, "1", p, "L", 30, 60, f"r{i}") for i, p in enumerate([100, 108, 115, 118, 500])]
    df = spark.createDataFrame(rows, CLIP)
    chunks = cluster._near(df.select("chrom", "side", "pos").distinct(), ["chrom", "side"], ["pos"], 10).withColumn("carry", F.array().cast("array<struct<pos:int>>"))
    assert "Python" not in cluster._claimed_natively(chunks, 10)._jdf.queryExecution().toString()
    assert "Arrow" not in cluster._claimed_natively(chunks, 10)._jdf.queryExecution().toString()


def test_examples_are_the_first_reads(spark):
    rows = [(100 - i, 0, "1", 50, "L", 30, 60, f"r{100 - i}") for i in range(100)]
    got = cluster.clip_clusters(spark.createDataFrame(rows, CLIP).repartition(4), max_names=3).first()
    assert (got.example_reads, got.support, got.support_distinct) == ("r1,r2,r3", 100, 100)


def test_ranks_and_last_before(spark, cut):
    r = random.Random(4)
    marks = [(r.choice("ab"), r.randrange(500), i, f"m{i}") for i in range(150)]
    points = [(i, r.choice("abc"), r.randrange(-20, 700), "x") for i in range(150)]
    m = spark.createDataFrame(marks, "chrom string, p int, o int, name string").repartition(3)
    q = spark.createDataFrame(points, "id int, chrom string, at int, name string").repartition(3)
    got = places.last_before(q, m, "chrom", "at", "p", ["o"], F.col("name"), "found")
    last = lambda c, at: max(((p, o, n) for d, p, o, n in marks if d == c and p <= at), default=(0, 0, None))[2]
    assert {x.id: (x.found, x.name, x["at"]) for x in got.collect()} == {i: (last(c, at), n, at) for i, c, at, n in points}
    ranked = {x.name: x.k for x in places.ranked(m, ["chrom"], "p", ["o"], "k").collect()}
    whole = {x.name: x.k for x in places.ranked(m, ["chrom"], "p", ["o"], "k", whole=True).collect()}
    for c in "ab":
        assert [ranked[n] for d, _, _, n in sorted(marks) if d == c] == list(range(sum(x[0] == c for x in marks)))
    assert [whole[x[3]] for x in sorted(marks)] == list(range(len(marks)))


def test_genes_of_the_last_features_only(spark, monkeypatch, cut):
    monkeypatch.setattr(intervals, "LOOKED_AT", 6)
    r = random.Random(5)
    features = [("1", s, s + r.choice([3, 30, 400]), f"g{i}", i) for i in range(80) for s in [r.randrange(300)]]
    spans = [(i, "1", s, s + r.choice([0, 1, 50])) for i in range(60) for s in [r.randrange(400)]] + [(99, "2", 1, 5)]
    f, q = spark.createDataFrame(features, "chrom string, start0 int, end0 int, gene string, file_ord int"), spark.createDataFrame(spans, "ord int, chrom string, start int, `end` int")
    order = sorted(features, key=lambda x: x[1])

    def found(c, s, e, most):
        e = max(e, s + 1)
        front = [x for x in order if x[0] == c and x[1] < e]
        return sorted({x[3] for x in (front[-most:] if most else front) if x[2] > s})

    assert {x.ord: x.genes for x in intervals.genes_over(q, f, "ord", compat=True).collect()} == {i: found(c, s, e, 6) for i, c, s, e in spans}
    assert {x.ord: x.genes for x in intervals.genes_over(q, f, "ord").collect()} == {i: found(c, s, e, 0) for i, c, s, e in spans}


def test_empty_tables(spark):
    assert cluster.clip_clusters(spark.createDataFrame([], CLIP)).count() == 0
    assert cluster.indel_clusters(spark.createDataFrame([], INDEL)).count() == 0
    assert cluster.split_clusters(spark.createDataFrame([], SPLIT)).count() == 0
    assert cluster.sequential_merge(spark.createDataFrame([], EVENT)).count() == 0

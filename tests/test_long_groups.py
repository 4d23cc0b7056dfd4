"""A group over many chunks settles in a few rounds."""

from __future__ import annotations

from locusframe.operators import cluster


def test_rounds_of_one_long_group(spark, monkeypatch):
    monkeypatch.setattr(cluster, "CHUNK", 10)
    rounds, plain = [], cluster.Steps.stash
    monkeypatch.setattr(cluster.Steps, "stash", lambda self, df, label: (rounds.append(label), plain(self, df, label))[1])
    rows = [(i, "chr1", i * 10, i * 10 + i % 3, "DEL", 5, f"r{i}", 30, 1) for i in range(200)]
    got = cluster.sequential_merge(spark.createDataFrame(rows, "ord long, chrom string, pos int, `end` int, svtype string, svlen int, read string, mapq int, support int")).collect()
    assert [(r.merged_count, r.support, r.pos, r.baseline_read) for r in got] == [(200, 200, 0, "r0")]
    assert rounds.count("chunks") <= 4

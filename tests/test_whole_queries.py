"""Queries do their whole job."""

from __future__ import annotations

from locusframe import registry

DATA = "/root/testdata/sf0.001"


def _distances(hits, start, end):
    places = [int(x.rsplit("|", 1)[1]) for x in hits.split(",") if x]
    return [max(start - p, p - end, 0) for p in places]


def test_splice_hits_reach_ten_bases(spark):
    found = [d for r in registry.QUERIES["splice_hits"](spark, DATA).collect() for d in _distances(r.hits, r.start, r.end)]
    assert 2 < max(found) <= 10


def test_exon_lines_have_hits_within_ten_bases(spark):
    found = []
    for r in registry.QUERIES["exon_vcf_body"](spark, DATA).collect():
        info = dict(x.split("=", 1) for x in r.value.split("\t")[7].split(";"))
        # an insertion is one base
        found += _distances(info.get("HITS", ""), r.start, r.start) if info["SVTYPE"] == "INS" else []
    assert 2 < max(found) <= 10

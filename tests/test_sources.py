"""Readers, samples, run counts and the error log on awkward files."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from locusframe import schema
from locusframe.functions import text
from locusframe.operators import intervals, observe
from locusframe.sinks import text as sinks
from locusframe.sources import text as sources
from locusframe.steps import Steps
from locusframe.streaming.observations import indel_stream

EVENT = "ord long, chrom string, pos int, `end` int, svtype string, svlen int, read string, mapq int, support long"


def test_merged_table_by_name(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("chrom\tstart\tend\ttype\tsupport\tmedian_sv_len\tclusterid\textra\nchr1\t10\t90\tDEL\t3\t80\tcluster_001\tx\n")
    got = sources.read_merged(spark, str(tmp_path / "m.tsv"))
    assert [f"{n} {t}" for n, t in got.dtypes] == [c.strip().replace("`", "") for c in schema.MERGED.split(",")]
    assert tuple(got.first()) == ("cluster_001", "chr1", 10, 90, "DEL", 3, 80, None, None, None, None)
    (tmp_path / "n.tsv").write_text("chrom\tstart\ttype\tsupport\tmedian_sv_len\n1\t1\tDEL\t1\t1\n")
    with pytest.raises(ValueError, match="end"):
        sources.read_merged(spark, str(tmp_path / "n.tsv"))


def test_sv_csv_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Chr,End,Start,SVType,SVLen,Readname(ID)\n chr1 ,80,10,DEL,NA,r1\nchr2,5,9,,7,\n")
    got = sources.read_sv_csv(spark, str(tmp_path / "a.csv")).orderBy("chrom").collect()
    assert [tuple(r)[1:] for r in got] == [("chr1", 10, 80, "r1", "DEL", "NA"), ("chr2", 5, 9, None, None, "7")]
    (tmp_path / "b.csv").write_text("ID,Start,End,Chr\nr7,1,2,3\n")
    assert tuple(sources.read_sv_csv(spark, str(tmp_path / "b.csv")).first())[1:] == ("3", 1, 2, "r7", None, None)
    (tmp_path / "c.csv").write_text("Start,End\n1,2\n")
    with pytest.raises(ValueError, match="Chr"):
        sources.read_sv_csv(spark, str(tmp_path / "c.csv"))


PER_READ = "chrom\tpos_start\tpos_end\tread_name\tsv_type\tsv_len\tnote\tread_len\tcigar\tMAPQ\tTLEN\tMATE_UNMAPPED\tIS_PROPER_PAIR\tORIENTATION\tSEQ\n"


def test_per_read_candidates(spark, tmp_path):
    lines = [
        "1\t5\t5\t.\tins\t.\tn\t36\t5M\tx\t-7\t0\t1\tR/F\tACG",
        "1\t5\t9\tr2\tDEL\tabc\tn\t36\t5M\t9\t0\t0\t1\tF/F\tA",
        "1\t5\t9\tr3\tDEL\t-4\tn\tlong\t5M\t9\t0\t0\t1\tF/F\tA",
        "# a comment in between",
        "",
        "1\t5\t9\tr4\tDEL\t-4\t.\t.\t.\t.\t.\t.\t.\t.\t.",
        "2\t6\t9\t.\tDEL\t3\tn\t36\t5M\t9\t0\t1\t0\tF/F\tA",
    ]
    (tmp_path / "c.tsv").write_text("#x\n" + PER_READ + "\n".join(lines) + "\n")
    got = sources.read_candidates(spark, str(tmp_path / "c.tsv")).orderBy("ord")
    assert [f"{n} {t}" for n, t in got.dtypes] == [c.strip().replace("`", "") for c in schema.CANDIDATES.split(",")]
    rows = [tuple(r)[1:] for r in got.collect()]
    assert rows == [
        ("chr1", 5, 6, "INS", 0, "read_1", "-", 30, 1, "", "", "n", 36, "5M", -7, 0, 1, "R/F", "ACG"),
        ("chr1", 5, 9, "DEL", 4, "r4", "+", 30, 1, "", "", "", 0, "", 0, 0, 0, "F/F", ""),
        ("chr2", 6, 9, "DEL", 3, "read_5", "+", 9, 1, "", "", "n", 36, "5M", 0, 1, 0, "F/F", "A"),
    ]
    (tmp_path / "d.tsv").write_text("chrom\tpos_start\tpos_end\tsv_type\tsv_len\n1\t1\t2\tDEL\t1\n")
    with pytest.raises(ValueError, match="read_name"):
        sources.read_candidates(spark, str(tmp_path / "d.tsv"), "per_read")


def test_line_numbers_over_many_splits(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("#x\n" + PER_READ + "".join(("# c\n" if i % 7 == 0 else "") + f"1\t{i}\t{i + 9}\t.\tDEL\t9\tn\t36\t5M\t9\t0\t0\t1\tF/F\tA\n" for i in range(1, 400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = sources.read_candidates(spark, str(tmp_path / "c.tsv"))
        assert got.rdd.getNumPartitions() > 3
        assert all(r.read == f"read_{r.pos}" for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def sam(n, bad=(), lost=(), tlen=lambda i: i + 1):
    rows = []
    for i in range(n):
        if i in bad:
            rows.append(f"r{i}\tx\tchr1" if i % 2 else f"r{i}\tnone\tchr1\t1\t60\t40M\t*\t0\t0\t*\t*")
        else:
            rows.append(f"r{i}\t{9 if i in lost else 1}\tchr1\t{i + 1}\t60\t40M50I40M\t*\t0\t{0 if i in lost else tlen(i)}\t{'ACGTA' * (20 + i % 5)}\t*\tRG:Z:g")
    return "@HD\tVN:1.6\n@RG\tID:g\tPL:ONT\n" + "\n".join(rows) + "\n"


def test_good_and_bad_lines(spark, tmp_path):
    (tmp_path / "a.sam").write_text(sam(50, bad={3, 4, 20}))
    lines = sources.sam_lines(spark, str(tmp_path / "a.sam"))
    good, bad = sources.alignments_of(lines), sources.bad_lines(lines).orderBy("read_name").collect()
    assert (lines.count(), good.count(), len(bad)) == (50, 47, 3)
    assert [tuple(r) for r in bad] == [("r20", "bad_line", "FLAG is no number"), ("r3", "bad_line", "3 of 11 fields"), ("r4", "bad_line", "FLAG is no number")]
    assert {r.rg_platform for r in sources.read_sam(spark, str(tmp_path / "a.sam")).collect()} == {"ONT"}
    sinks.write_errors(sources.bad_lines(lines), str(tmp_path / "log"))
    sinks.write_errors(sources.bad_lines(lines), str(tmp_path / "log"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect())[0] == "r20\tbad_line\tFLAG is no number"
    assert spark.read.text(str(tmp_path / "log")).count() == 6


def test_samples_read_the_first_partitions_only(spark, tmp_path):
    (tmp_path / "a.sam").write_text(sam(3000, bad={1, 2, 900}, lost={0, 5, 2000}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = sources.sam_lines(spark, str(tmp_path / "a.sam"))
        assert (parts := lines.rdd.getNumPartitions()) > 20
        tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
        sc.setJobGroup("sample", "sample")
        got = observe.length_sample(lines, 10).first()
        used = sum(tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("sample") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s))
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert used < parts
        assert (got.bam_type, got.median_len, got.n_reads, got.n_skipped) == ("short", 107, 10, 2)
        pairs = observe.insert_sizes(lines, 10).first()
        assert (pairs.median_tlen, pairs.n_pairs, pairs.n_unmapped, pairs.n_skipped, pairs.cutoff) == (9, 10, 2, 2, 1000)
        assert [r.qname for r in sources.first_reads(sources.alignments_of(lines), 2).collect()] == ["r0", "r3"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_samples_that_fill_late_or_never(spark, tmp_path):
    """Few hits among many other rows: all tasks look, with the same result as the plain rule."""
    r = random.Random(1)
    lost = {i for i in range(400) if r.random() < 0.97}
    (tmp_path / "a.sam").write_text(sam(400, lost=lost))
    lines = sources.sam_lines(spark, str(tmp_path / "a.sam"))
    hits = [i for i in range(400) if i not in lost]
    for n in (3, 500):
        got = observe.insert_sizes(lines, n).first()
        among = hits[:n]
        assert (got.n_pairs, got.n_unmapped) == (len(among), sum(i in lost and (n > len(hits) or i < among[-1]) for i in range(400)))
    (tmp_path / "b.sam").write_text(sam(1, bad={0}))
    none = observe.length_sample(sources.sam_lines(spark, str(tmp_path / "b.sam"))).first()
    assert tuple(none) == (None, 0, 0.0, 0, 1)
    assert tuple(observe.insert_sizes(sources.sam_lines(spark, str(tmp_path / "b.sam"))).first())[:4] == (0, 0.0, 0.0, 0)


def test_insert_sizes_of_all_reads(spark, tmp_path):
    (tmp_path / "a.sam").write_text(sam(6000, lost={3, 5999}))
    got = observe.insert_sizes(sources.sam_lines(spark, str(tmp_path / "a.sam")), None).first()
    assert (got.n_pairs, got.n_unmapped) == (5998, 2)


def test_counts_come_from_the_pass_that_writes(spark, tmp_path):
    (tmp_path / "a.sam").write_text(sam(20, bad={3, 4}))
    lines = sources.sam_lines(spark, str(tmp_path / "a.sam"))
    found, run = sinks.counted_candidates(lines, lambda reads: observe.legacy_candidates(reads, discordant=True), Steps(spark))
    assert (run.examined, run.skipped, run.types) == (20, 2, {"INS": 18, "DISC_PAIR": 18})
    told = [r.value for r in sinks.per_read_lines(found, run, bam_type="long").collect()]
    assert told[-11:-7] == ["#SUMMARY_total_examined=20", "#SUMMARY_total_candidates=36", "#SUMMARY_total_skipped=2", "#SUMMARY_INS=18"] and len(told) == 5 + 36 + 11
    assert told == [r.value for r in sinks.per_read_lines(found, 20, 2, bam_type="long").collect()]
    assert sinks.summary_lines(found, run, clusters=1) == sinks.summary_lines(found, 20, 2, 1)
    assert sinks.summary_lines(found, run)[-2:] == ["INS: 18 (50.0%)", "DISC_PAIR: 18 (50.0%)"]


def test_table_writers_of_observations(spark, tmp_path):
    (tmp_path / "a.sam").write_text(sam(5))
    found = observe.indels(observe.usable(sources.read_sam(spark, str(tmp_path / "a.sam"))))
    sinks.write_table(found, str(tmp_path / "i"), ["chrom", "pos"])
    got = spark.read.csv(str(tmp_path / "i"), sep="\t", header=True)
    assert got.columns == found.columns and [r.pos for r in got.orderBy(F.col("pos").cast("int")).collect()] == [str(41 + i) for i in range(5)]


def test_features_thresholds_strands(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('1\tH\tgene\t10\t20\t.\t+\t.\tgene_id "G"; gene_name "N";\n1\tH\tCDS\t5\t6\t.\t+\t.\tgene_id "G";\n1\tH\tUTR\t5\t6\t.\t+\t.\tgene_id "G";\n1\tH\texon\tx\t6\t.\t+\t.\tgene_id "G";\n1\tH\texon\t1\t2\t.\t+\t.\t;\n')
    assert [tuple(r)[:4] for r in sources.gtf_features(spark, str(tmp_path / "a.gtf")).orderBy("file_ord").collect()] == [("1", 9, 20, "N"), ("1", 4, 6, "G"), ("1", 0, 2, "NA")]
    assert observe.thresholds("long") == (200, 200, 200) and observe.thresholds("short") == observe.thresholds(None) == (30, 30, 30)
    ways = ["F/R", "R/F", "-", "+", ".", "", None]
    got = spark.createDataFrame([(i, w) for i, w in enumerate(ways)], "i int, w string").select("i", text.strand(F.col("w")).alias("s"))
    assert [r.s for r in got.orderBy("i").collect()] == ["+", "-", "-", "+", "+", "+", "+"]


def test_stream_of_alignments(spark, tmp_path):
    (tmp_path / "a.sam").write_text(sam(6))
    reads = sources.read_sam(spark, str(tmp_path / "a.sam"))
    reads.select(*[c.split()[0] for c in schema.ALIGNMENTS.split(", ")]).write.parquet(str(tmp_path / "in"))
    query = indel_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("indels").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.pos for r in spark.table("indels").collect()) == sorted(r.pos for r in observe.indels(observe.usable(reads)).collect()) != []


def test_collection_calls(spark):
    rows = [(i, f"chr{i % 2}", i, i + 5, "DEL" if i % 3 else "INS", 5, None if i == 2 else f"r{i}", 9, 1) for i in range(6)]
    held = intervals.Candidates(spark.createDataFrame(rows, EVENT))
    assert held.clear().rows.count() == 0 and held.clear().add(held.rows).rows.count() == 6
    assert [r.line for r in held.text(2).collect()] == ["chr0 DEL [2, 8) .", "chr0 DEL [4, 10) r4"]
    assert held.remove(held.rows.filter("ord < 4")).rows.count() == 2 and {(r.chrom, r.svtype): r.n for r in held.statistics().collect()} == {("chr0", "INS"): 1, ("chr1", "DEL"): 2, ("chr0", "DEL"): 2, ("chr1", "INS"): 1}

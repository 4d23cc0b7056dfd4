"""Single rules on hand-made rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from locusframe import schema
from locusframe.functions import text
from locusframe.operators import annotate, cluster, intervals, observe, places
from locusframe.sinks.text import merged_table, vcf_lines, write_table, write_vcf
from locusframe.sinks import text as sinks
from locusframe.sources import text as sources

PER_READ = "read_idx long, obs_idx int, chrom string, start int, `end` int, read_name string, sv_type string, sv_len int"
EVENT = "ord long, chrom string, pos int, `end` int, svtype string, svlen int, read string, mapq int, support long"


def read(spark, cigar, **more):
    row = {"read_idx": 1, "qname": "r", "flag": 0, "chrom": "chr1", "pos0": 100, "mapq": 60, "cigar": cigar, "tlen": 0, "seq": None, "tags": None, "rg_platform": None} | more
    return spark.createDataFrame([row], schema.ALIGNMENTS)


def test_gap_merge_pair(spark):
    rows = [(1, 0, "21", 33021905, 33021905, "ERR001302.10759664", "INS", 1), (2, 0, "21", 33021905, 33021905, "ERR001268.12534243", "INS", 2)]
    got = cluster.gap_merge(spark.createDataFrame(rows, PER_READ)).collect()
    assert [tuple(r) for r in got] == [("21", 33021905, 33021905, "INS", 2, 1, ["ERR001268.12534243", "ERR001302.10759664"])]


def test_gap_merge_running_maximum(spark):
    rows = [(1, 0, "1", 0, 500, "a", "DEL", 500), (2, 0, "1", 10, 20, "b", "DEL", 10), (3, 0, "1", 540, 560, "c", "DEL", 20), (4, 0, "1", 700, 710, "d", "DEL", 10)]
    got = cluster.gap_merge(spark.createDataFrame(rows, PER_READ), min_support=1).orderBy("start").collect()
    assert [(r.start, r.end, r.support) for r in got] == [(0, 560, 3), (700, 710, 1)]


def test_leaders_are_not_chained(spark):
    rows = [(i, 0, "1", p, "L", 30, 60, f"r{i}") for i, p in enumerate([100, 108, 115, 118])]
    got = cluster.clip_clusters(spark.createDataFrame(rows, "read_idx long, obs_idx int, chrom string, pos int, side string, cliplen int, mapq int, rname string")).orderBy("pos").collect()
    assert [(r.pos, r.support, r.example_reads) for r in got] == [(104, 2, "r0,r1"), (116, 2, "r2,r3")]


def test_sequential_merge_and_lost_group(spark):
    rows = [(0, "1", 100, 200, "DEL", 100, "a", 10, 1), (1, "1", 120, 210, "DEL", 91, "b", 20, 3), (2, "1", 500, 520, "DEL", 21, "c", 5, 2), (3, "2", 100, 100, "INS", 7, "d", 9, 2)]
    df = spark.createDataFrame(rows, EVENT)
    got = cluster.sequential_merge(df).orderBy("chrom", "pos").collect()
    assert [(r.chrom, r.pos, r.end, r.support, r.median_sv_len, r.mapq, r.read) for r in got] == [("1", 120, 210, 4, 95, 20, "merged_2_candidates"), ("1", 500, 520, 2, 21, 5, "c"), ("2", 100, 100, 2, 7, 9, "d")]
    lost = cluster.sequential_merge(df, compat=True).orderBy("chrom", "pos").collect()
    assert [(r.chrom, r.pos) for r in lost] == [("1", 120), ("2", 100)]
    assert [r.clusterid for r in merged_table(cluster.sequential_merge(df)).orderBy("clusterid").collect()] == ["cluster_001", "cluster_002", "cluster_003"]


def test_clips_poly_and_hard(spark):
    kept = lambda df: [(r.side, r.pos, r.cliplen) for r in observe.clips(df).orderBy("obs_idx").collect()]
    assert kept(read(spark, "30S20M30H", seq="ACGTC" * 10)) == [("L", 101, 30), ("R", 120, 30)]
    assert kept(read(spark, "30S20M", seq="A" * 30 + "C" * 20)) == []
    assert kept(read(spark, None)) == []


def test_discordant(spark):
    kinds = lambda flag, cigar="50M": [r.sv_type for r in observe.legacy_candidates(read(spark, cigar, flag=flag, tlen=5000), discordant=True, insert_cutoff=1000).orderBy("obs_idx").collect()]
    assert kinds(1) == ["DISC_PAIR", "LARGE_INSERT"]
    assert kinds(1 | 8) == ["MATE_UNMAPPED"]
    assert kinds(1 | 8, None) == ["MATE_UNMAPPED"]
    assert kinds(1 | 2) == ["LARGE_INSERT"]
    assert kinds(0) == []


def test_salvage(spark):
    found, bad = observe.salvage(read(spark, "40M50I7Q"))
    assert [(r.sv_type, r.start, r.note) for r in found.collect()] == [("INS", 140, "SALVAGED_CIGAR_I")]
    assert bad.count() == 1


def test_every_annotation_label(spark):
    exons = spark.createDataFrame([("1", "+", "t1", "A", 100, 200, 1), ("1", "+", "t1", "A", 301, 400, 2), ("1", "-", "t2", "B", 600, 700, 1)], "chrom string, strand string, tx_id string, gene string, s int, e int, exon_number int")
    exons = exons.withColumns({"chrom": F.concat(F.lit("chr"), "chrom"), **{c: F.lit(c) for c in ("tx_name", "gene_biotype", "tx_biotype")}})
    regions = annotate.transcript_regions(exons)
    assert [tuple(r)[1:3] for r in regions.filter("region_kind = 'intron'").collect()] == [(201, 301)]
    cases = [("1", 150, 650, "DEL", "Gene_Fusion"), ("1", 100, 201, "DEL", "Exonic_Deletion"), ("1", 100, 200, "DEL", "Intronic/Novel_Splicing"), ("1", 203, 299, "DEL", "Canonical_Splicing"), ("1", 220, 260, "DEL", "Intronic/Novel_Splicing"), ("1", 450, 460, "DEL", "Intergenic"), ("1", 150, 150, "DEL", "Intergenic"), ("1", 150, 150, "INS", "Intragenic_Insertion"), ("1", 150, 150, "INV", "Unclassified"), ("9", 1, 2, "DEL", None)]
    events = spark.createDataFrame([(i, *c[:4], 1, 1) for i, c in enumerate(cases)], "sv_id long, chrom string, start int, `end` int, svtype string, svlen int, support long")
    got = {r.sv_id: r.ann_type for r in annotate.annotate(events, regions).collect()}
    assert got == {i: c[4] for i, c in enumerate(cases) if c[4]}
    lines = {r.value.split("\t")[2]: r.value for r in vcf_lines(annotate.annotate(events, regions), "sv_id").collect()}
    assert "REGION=A,B;" in lines["0"] and {r.value.split("\t")[2] for r in vcf_lines(annotate.annotate(events, regions)).collect()} == {"."}
    assert "TX_NAME" in lines["0"] and "TX_NAME" not in lines["5"] and "REGION=Intergenic" in lines["5"]


def test_interval_join_across_bins(spark):
    a = spark.createDataFrame([(1, "1", 0, 100000), (2, "1", 16384, 16385), (3, "1", 5, 5)], "i int, c string, s int, t int")
    b = spark.createDataFrame([("x", "1", 16000, 40000), ("y", "1", 16385, 16390), ("z", "2", 0, 9)], "n string, c string, b int, e int")
    got = sorted((r.i, r.n) for r in intervals.interval_join(a, b, ["c"], ("s", "t"), ("b", "e")).collect())
    assert got == [(1, "x"), (1, "y"), (2, "x")]


def test_interval_join_of_all_lengths(spark):
    r = random.Random(2)
    spans = lambda n: [(i, r.choice("ab"), s, s + r.choice([0, 1, 5, 300, 3000, 90_000, 5_000_000])) for i in range(n) for s in [r.randrange(3_000_000)]]
    x, y = spans(150), spans(150)
    a, b = spark.createDataFrame(x, "i int, c string, s int, t int"), spark.createDataFrame(y, "j int, c string, b int, e int")
    got = sorted((q.i, q.j) for q in intervals.interval_join(a, b, ["c"], ("s", "t"), ("b", "e")).collect())
    assert got == sorted((i, j) for i, c, s, t in x for j, d, u, v in y if c == d and s < t and u < v and s < v and u < t)


def test_gap_merge_across_stretches(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, 0, "1", s, s + r.choice([0, 3, 40, 200]), f"r{i}", r.choice(["DEL", "INS"]), 5) for i in range(300) for s in [r.randrange(4000)]]
    df = spark.createDataFrame(rows, PER_READ)
    found = []
    for stretch in (1 << 20, 64):
        monkeypatch.setattr(places, "STRETCH", stretch)
        found.append(sorted(map(str, cluster.gap_merge(df, window=5).collect())))
    assert found[0] == found[1] and len(found[0]) > 10


def test_files(spark, tmp_path):
    sam = tmp_path / "a.sam"
    sam.write_text("@HD\tVN:1.6\n@RG\tID:g\tPL:ONT\nr1\t0\tchr1\t101\t60\t40M25I40M\t*\t0\t0\t" + "ACGTC" * 21 + "\t*\tRG:Z:g\tSA:Z:chr2,5,+,10S40M,60,0;\nr2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    reads = sources.read_sam(spark, str(sam))
    assert [tuple(r)[2:7] for r in observe.indels(observe.usable(reads)).collect()] == [("chr1", 141, "INS", 25, 60)]
    assert [(r.pos1, r.chrom2, r.pos2) for r in observe.splits(observe.usable(reads)).orderBy("obs_idx").collect()] == [(180, "chr2", 5), (101, "chr2", 44)]
    assert observe.read_type(reads).first()[0] == "long"
    gtf = tmp_path / "a.gtf"
    gtf.write_text('#x\n1\tH\texon\t10\t20\t.\t+\t.\tgene_id "G"; transcript_id "T"; tag "a"; tag "b"; level 1;\n1\tH\texon\t30\t40\t.\t+\t.\tgene_id "G"; transcript_id "T"; level 10;\n1\tH\tCDS\t30\t40\t.\t+\t.\tgene_id "G"; transcript_id "T"; level 1;\n')
    assert [(r.exon_rank, r.s, r.gene_id) for r in sources.gtf_exons(spark, str(gtf)).orderBy("s").collect()] == [(1, 10, "G"), (2, 30, "G")]
    assert [r.s for r in sources.gtf_curated(spark, str(gtf)).collect()] == [10]
    table = tmp_path / "c.tsv"
    table.write_text("#c\nchrom\tpos\tend\tsvtype\tlength\tsupport\tmedian_mapq\texample_reads\texample_ins_seq\tgenes\n1\t5\t5\tins\t30\t4\t.\ta,b\n1\tx\t5\tINS\t1\t1\t1\tc\t\t\n")
    got = sources.read_candidates(spark, str(table)).collect()
    assert [(r.chrom, r.pos, r.end, r.svtype, r.support, r.mapq) for r in got] == [("chr1", 5, 35, "INS", 4, 30)]
    merged = merged_table(cluster.sequential_merge(spark.createDataFrame([(0, "1", 5, 9, "DEL", 4, "a", 9, 2)], EVENT)))
    write_table(merged, str(tmp_path / "m"), ["clusterid"])
    assert sources.read_merged(spark, str(tmp_path / "m")).first().clusterid == "cluster_001"
    write_vcf(spark.createDataFrame([("1", 5, "x")], "chrom string, start int, value string"), str(tmp_path / "v"))
    assert [r.value for r in spark.read.text(str(tmp_path / "v")).collect()][-1] == "x"
    bed = tmp_path / "g.bed"
    bed.write_text("1\t9\t20\tABC\n1\t9\t20\t+\tENSG1\tlncRNA\tXYZ\n1\t9\t20\n")
    assert [(r.start1, r.name) for r in sources.read_gene_bed(spark, str(bed)).orderBy("file_ord").collect()] == [(10, "ABC"), (10, "+"), (10, "gene:1:10-20")]
    assert [(r.chrom, r.name) for r in sources.read_gene_bed(spark, str(bed), guess=True).orderBy("file_ord", "chrom").collect()] == [(c, n) for n in ("ABC", "lncRNA", "") for c in ("1", "chr1")]


def test_sam_files_with_one_read_group_repeated_tags_and_many_tags(spark, tmp_path):
    row = "r{}\t0\tchr1\t101\t60\t40M\t*\t0\t0\t*\t*\tRG:Z:g\tSA:Z:a\tSA:Z:b\t" + "\t".join(f"{chr(65 + i // 50)}{chr(48 + i % 50)}:i:{i}" for i in range(1500)) + "\n"
    for i, platform in enumerate(("ONT", "ILLUMINA")):
        (tmp_path / f"{i}.sam").write_text(f"@RG\tID:g\tPL:{platform}\n@RG\tID:g\tPL:OTHER\n" + row.format(i))
    got = sources.read_sam(spark, str(tmp_path)).orderBy("qname").collect()
    assert [(r.qname, r.rg_platform, r.tags["SA"], len(r.tags)) for r in got] == [("r0", "ONT", "a", 1500), ("r1", "ILLUMINA", "a", 1500)]
    assert [r.qname for r in sources.first_reads(sources.read_sam(spark, str(tmp_path / "0.sam")), 1).collect()] == ["r0"]
    bad = spark.createDataFrame([("a,1,+,5M,3,0;bad;",)], "sa string").select(F.size(text.sa_entries(F.col("sa"))).alias("n"), text.sa_entries(F.col("sa"), True).alias("none"))
    assert [tuple(r) for r in bad.collect()] == [(1, None)]


def test_candidate_tables(spark, tmp_path):
    assert sources.candidate_format(["pos", "end", "svtype", "length", "read_name", "MAPQ"]) == "clustered"
    assert sources.candidate_format(["pos_start", "pos_end", "pos", "end"]) == "per_read"
    head = "chrom\tpos_start\tpos_end\tread_name\tsv_type\tsv_len\n"
    (tmp_path / "c.tsv").write_text("#x\n" + head + "1\t5\t5\tr1\tins\t-7\n1\t5\t5\tr2\tINS\n1\t5\t5\tr3\tINS\t1\tmore\n2\t1\t9\t.\tDEL\t.  \n")
    got = sources.read_candidates(spark, str(tmp_path / "c.tsv")).orderBy("ord").collect()
    assert [(r.chrom, r.pos, r.end, r.svtype, r.svlen, r.read == "r1") for r in got] == [("chr1", 5, 12, "INS", 7, True), ("chr2", 1, 9, "DEL", 0, False)]


def test_per_read_table_and_summary(spark):
    reads = read(spark, "40M50I40M", flag=1, tlen=7)
    found = observe.legacy_candidates(reads, discordant=True)
    lines = [r.value for r in sinks.per_read_lines(found, examined=3, skipped=1, bam_type="short", median_len=9, mean_len=9.25).collect()]
    assert lines[:4] == ["#BAM_CLASSIFICATION=short", "#SAMPLED_MEDIAN_READLEN=9", "#SAMPLED_MEAN_READLEN=9.2", "#THRESHOLDS_INS=30\tDEL=30\tSOFTCLIP=30\tMQ=20"]
    assert [x.split("\t")[4] for x in lines[5:7]] == ["INS", "DISC_PAIR"] and len(lines[5].split("\t")) == 15
    assert lines[7:11] == ["#SUMMARY_total_examined=3", "#SUMMARY_total_candidates=2", "#SUMMARY_total_skipped=1", "#SUMMARY_INS=1"] and lines[-2:] == ["#SUMMARY_DISC_PAIR=1", "#SUMMARY_LARGE_INSERT=0"]
    told = sinks.summary_lines(found.union(found.filter("sv_type = 'DISC_PAIR'")), 3, 1, 2)
    assert told[-2:] == ["DISC_PAIR: 2 (66.7%)", "INS: 1 (33.3%)"] and '  "clusters_found": 2' in told


def test_vcf_heads_regions_and_genes(spark, tmp_path):
    body = spark.createDataFrame([("chr2", 5, "b"), ("chr1", 9, "a")], "chrom string, start int, value string")
    for version, n in (("4.2", 13), ("4.3", 8)):
        write_vcf(body, str(tmp_path / version), version)
        lines = [r.value for r in spark.read.text(str(tmp_path / version)).collect()]
        assert len(lines) == n + 2 and lines[0].endswith(version) and sorted(lines[n:]) == ["a", "b"]
    regions = spark.createDataFrame([("chr1", 1, 5, "g", "t", "exon", 1, "n", "b", "x"), ("chr2", 1, 5, "g", "t", "exon", 1, "n", "b", "x")], schema.TX_REGIONS)
    sinks.write_regions(regions, str(tmp_path / "r"))
    assert sources.read_regions(spark, str(tmp_path / "r"), ["chr2"]).count() == 1
    assert sorted(map(tuple, sources.read_regions(spark, str(tmp_path / "r")).select(regions.columns).collect())) == sorted(map(tuple, regions.collect()))
    genes = spark.createDataFrame([("chr1", "gene", 10, 20, "+", "A", "ENSG1", "lncRNA"), ("chr1", "exon", 10, 20, "+", "A", "ENSG1", "lncRNA")], "chrom string, feature string, s int, e int, strand string, gene string, gene_id string, gene_biotype string")
    assert [tuple(r) for r in sinks.gene_bed(genes).collect()] == [("chr1", 10, 20, "+", "ENSG1", "lncRNA", "A")]
    assert sinks.gene_bed(genes, true_bed=True).first().start == 9


def test_text_rules(spark):
    row = spark.range(1).select(text.within(F.lit(5), F.lit(9), 4), text.length_similar(F.lit(100), F.lit(111)), text.length_similar(F.lit(100), F.lit(112)), text.overlap_closed(F.lit(1), F.lit(5), F.lit(5), F.lit(9)), text.contained(F.lit(2), F.lit(3), F.lit(1), F.lit(3)), text.strand(F.lit("R/F")), text.sv_length(F.lit("NA"), F.lit("del"), F.lit(5), F.lit(9)), text.end_of(F.lit("DEL"), F.lit(5), F.lit(3))).first()
    assert tuple(row) == (True, True, False, True, True, "-", -5, 7)


def test_utr_regions(spark):
    u = spark.createDataFrame([("chr1", "+", "t1", "A", 90, 99, 1)], "chrom string, strand string, tx_id string, gene string, s int, e int, exon_number int").withColumns({c: F.lit(c) for c in ("tx_name", "gene_biotype", "tx_biotype")})
    assert [(r.region_kind, r.begin, r.end_excl) for r in annotate.transcript_regions(u.limit(0), u).collect()] == [("UTR", 90, 100)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], EVENT)
    assert cluster.sequential_merge(none).count() == 0
    assert intervals.self_overlap(none, 10).count() == 0
    assert observe.indels(spark.createDataFrame([], schema.ALIGNMENTS)).count() == 0


def test_stored_spans(spark, tmp_path):
    r = random.Random(8)
    spans = lambda n: [(i, r.choice("ab"), s, s + r.choice([0, 1, 5, 300, 3000, 90_000, 5_000_000])) for i in range(n) for s in [r.randrange(3_000_000)]]
    x, y = spans(150), spans(150)
    a, b = spark.createDataFrame(x, "i int, c string, s int, t int"), spark.createDataFrame(y, "j int, c string, b int, e int")
    stored = intervals.StoredSpans.write(b, "stored_spans", ["c"], ("b", "e"), 4, str(tmp_path / "stored"))
    got = intervals.interval_join(a, stored, ["c"], ("s", "t"), ("b", "e"))
    plain = intervals.interval_join(a, b, ["c"], ("s", "t"), ("b", "e"))
    assert sorted(got.columns) == sorted(plain.columns)
    assert sorted((q.i, q.j) for q in got.collect()) == sorted((i, j) for i, c, s, t in x for j, d, u, v in y if c == d and s < t and u < v and s < v and u < t)
    assert sorted(map(tuple, stored.rows.select("j", "c", "b", "e").collect())) == sorted(q for q in y if q[3] > q[2])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = lambda df: sum("Exchange hashpartitioning(c" in line and "_bin" in line for line in df._jdf.queryExecution().executedPlan().toString().split("\n"))
        assert (dealt(plain.select("i", "j")), dealt(intervals.interval_join(a, stored, ["c"], ("s", "t"), ("b", "e")).select("i", "j"))) == (4, 2)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table stored_spans")

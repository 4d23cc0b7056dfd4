"""Observations of single reads: insertions, deletions, clips, split reads and discordant pairs.

Generators work inside the row (no shuffle). obs_idx numbers the observations of a read in reading order, so that
(read_idx, obs_idx) stands for file order wherever a first one is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar, text
from ..schema import DUPLICATE, MATE_UNMAPPED, PAIRED, PROPER, SECONDARY, UNMAPPED


def usable(reads: DataFrame, min_mapq: int = 20) -> DataFrame:
    """Mapped primary and supplementary reads that are no duplicates, of this mapping quality or better."""
    return reads.filter((F.col("flag").bitwiseAND(UNMAPPED | SECONDARY | DUPLICATE) == 0) & (F.col("mapq") >= min_mapq))


def usable_legacy(reads: DataFrame, min_mapq: int = 20) -> DataFrame:
    """Mapped reads with a reference name and this mapping quality; secondary ones and duplicates stay."""
    return reads.filter((F.col("flag").bitwiseAND(UNMAPPED) == 0) & (F.col("mapq") >= min_mapq) & F.col("chrom").isNotNull() & (F.col("chrom") != "*"))


def _with_ops(reads: DataFrame) -> DataFrame:
    return reads.withColumn("ops", F.when(cigar.is_cigar(F.col("cigar")), cigar.ops(F.col("cigar"))))


def indels(reads: DataFrame, min_ins: int = 20, min_del: int = 20) -> DataFrame:
    """Insertions and deletions of filtered reads, 1-based: read_idx, obs_idx, chrom, pos, svtype, length, mapq, rname, seq (inserted bases, null for deletions)."""
    big = lambda x: ((x["op"] == "I") & (x["len"] >= min_ins)) | ((x["op"] == "D") & (x["len"] >= min_del))
    found = _with_ops(reads).select("read_idx", "chrom", "pos0", "mapq", "qname", "seq", F.explode(cigar.placed(F.col("ops"), big)).alias("x"))
    ins = F.col("x.op") == "I"
    return found.select(
        "read_idx",
        F.col("x.i").alias("obs_idx"),
        "chrom",
        (F.col("pos0") + F.col("x.ref") + 1).alias("pos"),
        F.when(ins, F.lit("INS")).otherwise(F.lit("DEL")).alias("svtype"),
        F.col("x.len").alias("length"),
        "mapq",
        F.col("qname").alias("rname"),
        F.when(ins, F.substring(F.col("seq"), F.col("x.read") + 1, F.col("x.len"))).alias("seq"),
    )


def clips(reads: DataFrame, min_clip: int = 25, poly_min: int = 20, short_poly: bool = False) -> DataFrame:
    """Soft and hard clips at read ends that aren't poly-A or poly-T, 1-based: read_idx, obs_idx, chrom, pos, side (L, R), cliplen, mapq, rname.

    ``short_poly`` tests clips shorter than ``poly_min`` on their whole length (short reads). Hard clips have no bases to test.
    """
    rows = _with_ops(reads).filter(F.size("ops") > 0).withColumn("span", cigar.ref_span(F.col("ops")))
    first, last = F.get("ops", F.lit(0)), F.get("ops", F.size("ops") - 1)

    def end(x: Column, side: str) -> Column:
        n = x["len"]
        start = F.lit(1) if side == "L" else F.length("seq") - n + 1
        bases = F.when(x["op"] == "S", F.substring(F.col("seq"), F.greatest(F.lit(1), start), n)).otherwise(F.lit(""))
        least = F.least(F.lit(poly_min), n) if short_poly else F.lit(poly_min)
        keep = x["op"].isin("S", "H") & (n >= min_clip) & ~cigar.is_poly_at(bases, least)
        pos = F.col("pos0") + 1 if side == "L" else F.col("pos0") + F.col("span")
        return F.when(keep, F.struct(x["i"].alias("i"), pos.alias("pos"), F.lit(side).alias("side"), n.alias("n")))

    both = F.filter(F.array(end(first, "L"), end(last, "R")), lambda x: x.isNotNull())
    found = rows.select("read_idx", "chrom", "mapq", "qname", F.explode(both).alias("x"))
    idx = F.col("x.i") * 2 + F.when(F.col("x.side") == "R", 1).otherwise(0)
    return found.select("read_idx", idx.alias("obs_idx"), "chrom", "x.pos", "x.side", F.col("x.n").alias("cliplen"), "mapq", F.col("qname").alias("rname"))


def splits(reads: DataFrame, whole_tags: bool = False) -> DataFrame:
    """Two rows for each SA entry: right end to its start, left end to its end.

    Bad entries are left out one by one; with ``whole_tags``, the long-read rule, a bad entry drops its tag.

    read_idx, obs_idx, chrom1, pos1, chrom2, pos2, mapq, rname, same_chrom, note.
    """
    rows = _with_ops(reads).withColumn("sa", F.explode(F.transform(text.sa_entries(F.col("tags")["SA"], whole_tags), lambda e, k: F.struct(k.alias("k"), e.alias("e")))))
    rows = rows.filter(cigar.is_cigar(F.col("sa.e.cigar"))).withColumn("span2", cigar.ref_span(cigar.ops(F.col("sa.e.cigar"))))
    pos2 = F.col("sa.e.pos")
    right = F.struct(F.lit(0).alias("j"), (F.col("pos0") + F.coalesce(cigar.ref_span(F.col("ops")), F.lit(0))).alias("pos1"), pos2.alias("pos2"), F.lit("primaryR->SAstart").alias("note"))
    left = F.struct(F.lit(1).alias("j"), (F.col("pos0") + 1).alias("pos1"), F.when(F.col("span2") > 0, pos2 + F.col("span2") - 1).otherwise(pos2).alias("pos2"), F.lit("primaryL->SAend").alias("note"))
    out = rows.withColumn("x", F.explode(F.array(right, left)))
    return out.select("read_idx", (F.col("sa.k") * 2 + F.col("x.j")).alias("obs_idx"), F.col("chrom").alias("chrom1"), "x.pos1", F.col("sa.e.rname").alias("chrom2"), "x.pos2", "mapq", F.col("qname").alias("rname"), (F.col("chrom") == F.col("sa.e.rname")).alias("same_chrom"), "x.note")


_TRAIL = ("read_len", "cigar", "mapq", "tlen", "mate_unmapped", "is_proper_pair", "orientation", "seq")


def legacy_candidates(reads: DataFrame, ins: int = 30, dele: int = 30, clip: int = 30, large_n: int | None = None, discordant: bool = False, insert_cutoff: int | None = None) -> DataFrame:
    """Per-read candidates, 0-based: read_idx, obs_idx, chrom, start, end, read_name, sv_type, sv_len, note and what the per-read table shows of the read.

    INS, DEL, SOFTCLIP (soft clips only, also inner ones), LARGE_N if ``large_n`` is set, SPLIT for reads with an SA tag. With
    ``discordant`` also MATE_UNMAPPED, or else DISC_PAIR for pairs that aren't proper and in addition LARGE_INSERT from
    ``insert_cutoff``. Reads without a CIGAR give MATE_UNMAPPED only.
    """
    flag, n = F.col("flag"), F.size("ops")
    rows = _with_ops(reads).withColumn("ops", F.coalesce("ops", F.array().cast("array<struct<i:int,op:string,len:int>>")))
    rows = rows.withColumn("end0", F.when(n > 0, F.col("pos0") + cigar.ref_span(F.col("ops"))).otherwise(F.col("pos0")))
    hit = lambda x: ((x["op"] == "I") & (x["len"] >= ins)) | ((x["op"] == "D") & (x["len"] >= dele)) | ((x["op"] == "S") & (x["len"] >= clip)) | ((x["op"] == "N") & (x["len"] >= large_n) if large_n else F.lit(False))

    def event(x: Column) -> Column:
        at = F.col("pos0") + x["ref"]
        op = x["op"]
        kind = F.when(op == "I", "INS").when(op == "D", "DEL").when(op == "S", "SOFTCLIP").otherwise("LARGE_N")
        side = F.when(x["i"] == 0, "CIGAR_S_left").when(x["i"] == n - 1, "CIGAR_S_right").otherwise("CIGAR_S_internal")
        note = F.when(op == "S", side).otherwise(F.concat(F.lit("CIGAR_"), op))
        return F.struct(x["i"].alias("obs_idx"), at.alias("start"), F.when(op.isin("D", "N"), at + x["len"] - 1).otherwise(at).alias("end"), kind.alias("sv_type"), x["len"].alias("sv_len"), note.alias("note"))

    def whole(idx: int, kind: str, length: Column, note: str, when: Column) -> Column:
        made = F.struct(F.lit(1_000_000 + idx).alias("obs_idx"), F.col("pos0").alias("start"), F.col("end0").alias("end"), F.lit(kind).alias("sv_type"), length.cast("int").alias("sv_len"), F.lit(note).alias("note"))
        return F.when(when, made)

    size = F.abs(F.coalesce("tlen", F.lit(0)))
    aligned = n > 0
    extra = [whole(0, "SPLIT", F.lit(0), "SA_tag", aligned & F.col("tags")["SA"].isNotNull())]
    if discordant:
        paired, lost = flag.bitwiseAND(PAIRED) != 0, flag.bitwiseAND(MATE_UNMAPPED) != 0
        extra.append(whole(1, "MATE_UNMAPPED", F.lit(0), "MATE_UNMAPPED", paired & lost))
        extra.append(whole(2, "DISC_PAIR", size, "NOT_PROPER_PAIR", aligned & paired & ~lost & (flag.bitwiseAND(PROPER) == 0)))
        if insert_cutoff:
            extra.append(whole(3, "LARGE_INSERT", size, "LARGE_INSERT_TLEN", aligned & paired & ~lost & (size >= insert_cutoff)))
    events = F.concat(F.transform(cigar.placed(F.col("ops"), hit), event), F.filter(F.array(*extra), lambda x: x.isNotNull()))
    shown = rows.withColumns(
        {
            "read_len": F.coalesce(F.length("seq"), F.lit(0)),
            "mate_unmapped": (flag.bitwiseAND(MATE_UNMAPPED) != 0).cast("int"),
            "is_proper_pair": (flag.bitwiseAND(PROPER) != 0).cast("int"),
            "orientation": text.orientation(flag),
        }
    )
    return shown.withColumn("x", F.explode(events)).select("read_idx", "x.obs_idx", "chrom", "x.start", "x.end", F.col("qname").alias("read_name"), "x.sv_type", "x.sv_len", "x.note", *_TRAIL)


def salvage(reads: DataFrame, ins: int = 30, dele: int = 30, clip: int = 30) -> tuple[DataFrame, DataFrame]:
    """Reads whose CIGAR doesn't parse: (candidates of the operations that can be read, with SALVAGED_CIGAR_ notes; quarantine of read_name, kind, message).

    Reads without a CIGAR ('*' or null) are no errors.
    """
    bad = reads.filter(F.col("cigar").isNotNull() & (F.col("cigar") != "*") & ~cigar.is_cigar(F.col("cigar")))
    big = lambda x: ((x["op"] == "I") & (x["len"] >= ins)) | ((x["op"] == "D") & (x["len"] >= dele)) | ((x["op"] == "S") & (x["len"] >= clip))
    found = bad.withColumn("ops", cigar.ops(F.col("cigar"))).select("read_idx", "chrom", "pos0", "qname", F.explode(cigar.placed(F.col("ops"), big)).alias("x"))
    at, op = F.col("pos0") + F.col("x.ref"), F.col("x.op")
    out = found.select("read_idx", F.col("x.i").alias("obs_idx"), "chrom", at.alias("start"), F.when(op == "D", at + F.col("x.len") - 1).otherwise(at).alias("end"), F.col("qname").alias("read_name"), F.when(op == "I", "INS").when(op == "D", "DEL").otherwise("SOFTCLIP").alias("sv_type"), F.col("x.len").alias("sv_len"), F.concat(F.lit("SALVAGED_CIGAR_"), op).alias("note"))
    return out, bad.select(F.col("qname").alias("read_name"), F.lit("parse_error").alias("kind"), F.concat(F.lit("bad CIGAR: "), "cigar").alias("message"))


# Platforms of long reads.
LONG_PLATFORMS = ("PACBIO", "PACBIO_RS", "PACBIO_SMRT", "PACBIO_HIFI", "ONT", "OXFORD_NANOPORE")


def read_type(reads: DataFrame) -> DataFrame:
    """One row, bam_type: short if a platform contains ILLUMINA, long if one is a long-read platform, else null."""
    p = F.upper("rg_platform")
    short = F.max(F.when(p.contains("ILLUMINA"), 1).otherwise(0)) == 1
    long = F.max(F.when(p.isin(*LONG_PLATFORMS), 1).otherwise(0)) == 1
    return reads.agg(F.when(short, "short").when(long, "long").alias("bam_type"))


#: Rows that are read on the driver for a sample, by its size; a sample that isn't complete by then is taken by all tasks.
_AT_ONCE = 4


def _sampled(rows: DataFrame, sample: int) -> tuple[DataFrame, Column]:
    """The rows (read_idx, hit, …), in file order, up to the one with which the hits are ``sample``, and the condition that a row is among those.

    Partitions are read one after the other, more at a time, so the first reads of a large file are all that is read. Only where
    they don't fill the sample (few hits among many other rows) all rows are looked at.
    """
    got = rows.take(_AT_ONCE * sample)
    hits = [i for i, r in enumerate(got) if r["hit"]]
    if len(hits) >= sample or len(got) < _AT_ONCE * sample:
        kept = got[: hits[sample - 1] + 1] if len(hits) >= sample else got
        return rows.sparkSession.createDataFrame(kept, rows.schema), F.lit(True)
    last = rows.filter("hit").orderBy("read_idx").limit(sample).agg(F.max("read_idx").alias("_last"), F.count(F.lit(1)).alias("_hits"))
    # one row on one side
    return rows.join(F.broadcast(last)), (F.col("_hits") < sample) | (F.col("read_idx") <= F.col("_last"))


def _error(reads: DataFrame) -> Column:
    """Whether a row is a line that is no alignment; reads without that column have none."""
    return F.col("error").isNotNull() if "error" in reads.columns else F.lit(False)


def length_sample(reads: DataFrame, sample: int = 5000, cutoff: int = 1000) -> DataFrame:
    """bam_type (short if the median is below the cutoff), median, mean and n of the first ``sample`` reads with bases, and n_skipped.

    Reads come in file order; of rows of ``sources.text.sam_lines`` those that are no alignments are skipped and counted, up to the last
    read of the sample. Without reads bam_type is null and the others are 0.
    """
    n = F.coalesce(F.length("seq"), F.lit(0))
    rows = reads.select("read_idx", (~_error(reads) & (n > 0)).alias("hit"), _error(reads).alias("bad"), n.alias("n")).filter("hit or bad")
    rows, among = _sampled(rows, sample)
    n = F.when(F.col("hit"), F.col("n"))
    m = F.percentile(n, F.lit(0.5)).cast("int")
    return rows.filter(among).agg(F.when(m < cutoff, "short").when(m.isNotNull(), "long").alias("bam_type"), F.coalesce(m, F.lit(0)).alias("median_len"), F.coalesce(F.avg(n), F.lit(0.0)).alias("mean_len"), F.count(n).alias("n_reads"), F.count_if("bad").alias("n_skipped"))


def insert_sizes(reads: DataFrame, sample: int | None = 5000) -> DataFrame:
    """Median, mean and population deviation of the first ``sample`` paired reads (None: of all) with a template length, the cutoff for large inserts, n_unmapped and n_skipped.

    The cutoff is the median and three deviations, 1000 at least. n_unmapped counts paired reads without a template
    length whose mate is unmapped, n_skipped lines that are no alignments (of ``sources.text.sam_lines``), both up to the last read of the sample.
    Without such reads all numbers are 0.
    """
    paired, t = F.col("flag").bitwiseAND(PAIRED) != 0, F.abs(F.coalesce("tlen", F.lit(0)))
    bad, good = _error(reads), ~_error(reads)
    rows = reads.select("read_idx", F.coalesce(good & paired & (t > 0), F.lit(False)).alias("hit"), bad.alias("bad"), F.coalesce(good & paired & (t == 0) & (F.col("flag").bitwiseAND(MATE_UNMAPPED) != 0), F.lit(False)).alias("lost"), t.alias("t")).filter("hit or bad or lost")
    rows, among = _sampled(rows, sample) if sample is not None else (rows, F.lit(True))
    t = F.when(F.col("hit"), F.col("t"))
    made = rows.filter(among).agg(F.coalesce(F.percentile(t, F.lit(0.5)).cast("int"), F.lit(0)).alias("median_tlen"), F.coalesce(F.avg(t), F.lit(0.0)).alias("mean_tlen"), F.coalesce(F.stddev_pop(t), F.lit(0.0)).alias("std_tlen"), F.count(t).alias("n_pairs"), F.count_if("lost").alias("n_unmapped"), F.count_if("bad").alias("n_skipped"))
    return made.withColumn("cutoff", F.greatest(F.lit(1000), (F.col("median_tlen") + 3 * F.col("std_tlen")).cast("int")))


def thresholds(bam_type: str | None) -> tuple[int, int, int]:
    """Least insertion, deletion and clip for a type of reads."""
    return (200, 200, 200) if bam_type == "long" else (30, 30, 30)

"""Text formats of the workflow as DataFrames.

File order matters where a first row is taken, so readers that need it give ord: monotonically increasing in file
order, by Spark's partition number and place in it, never by a shuffle to one task. That is the order of one file; of
several files Spark packs the largest first, so rules about a first row hold inside each file only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import attribute, chr_name, strand
from ..steps import ship_package

_SAM = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value and ord of the lines, CR at the end removed."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.monotonically_increasing_id().alias("ord"))


#: Least fields of an alignment, and what its numbers are called in messages.
_FIELDS, _NUMBERS = 11, {"flag": "FLAG", "pos": "POS", "mapq": "MAPQ", "tlen": "TLEN"}


def sam_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of SAM text (gzip too) that is no header, with the columns of ``schema.ALIGNMENTS`` and error: null, or why it is no alignment.

    One pass gives both: ``alignments_of`` takes the good rows, ``bad_lines`` the others. A line without 11 fields or
    with no number where one belongs is no alignment; a tag without its two colons is left out. '*' is null for cigar and seq. Of a
    tag that is there twice the first counts. rg is the read's group; file its file.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.monotonically_increasing_id().alias("ord"), F.col("_metadata.file_path").alias("file"))
    body = lines.filter(~F.startswith("value", F.lit("@")) & (F.trim("value") != "")).withColumn("p", F.split("value", "\t"))
    field = {name: F.get("p", F.lit(i)) for i, name in enumerate(_SAM)}
    known = lambda c: F.when(c != "*", c)
    number = {name: field[name].try_cast("int") for name in _NUMBERS}
    wrong = F.array_join(F.array_compact(F.array(*[F.when(number[n].isNull(), F.lit(f"{told} is no number")) for n, told in _NUMBERS.items()])), ", ")
    error = F.when(F.size("p") < _FIELDS, F.format_string("%d of 11 fields", F.size("p"))).when(wrong != "", wrong)
    tags = _tags(F.filter(F.slice("p", 12, F.greatest(F.size("p"), F.lit(1))), lambda t: F.substring(t, 3, 1) == ":"))
    return body.select(F.col("ord").alias("read_idx"), field["qname"].alias("qname"), number["flag"].alias("flag"), field["rname"].alias("chrom"), (number["pos"] - 1).alias("pos0"), number["mapq"].alias("mapq"), known(field["cigar"]).alias("cigar"), number["tlen"].alias("tlen"), known(field["seq"]).alias("seq"), tags.alias("tags"), "file", error.alias("error"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """file, rg and rg_platform of the read groups in the headers of SAM text; of a group that is there twice the first counts.

    Header lines stand at the beginning of a file and no read's name begins with @, so a task stops at its first line that isn't one.
    """
    ship_package(spark)
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("ord"), F.col("_metadata.file_path").alias("file"))
    heads = lines.mapInArrow(_header_lines, "value string, ord bigint, file string")
    at = F.struct("ord", F.regexp_extract("value", "\tPL:([^\t]*)", 1).alias("platform"))
    return heads.filter(F.startswith("value", F.lit("@RG"))).groupBy("file", F.regexp_extract("value", "\tID:([^\t]*)", 1).alias("rg")).agg(F.min(at)["platform"].alias("rg_platform"))


def alignments_of(lines: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The good rows of ``sam_lines`` in the schema of ``schema.ALIGNMENTS``; rg_platform from the read groups of the same file, null without them."""
    reads = lines.filter("error is null").drop("error").withColumn("rg", F.col("tags")["RG"])
    if groups is None:
        return reads.withColumn("rg_platform", F.lit(None).cast("string")).drop("rg", "file")
    return reads.join(groups, ["file", "rg"], "left").drop("rg", "file")


def bad_lines(lines: DataFrame) -> DataFrame:
    """The other rows of ``sam_lines`` for the error log: read_name, kind, message."""
    return lines.filter("error is not null").select(F.coalesce("qname", F.lit("UNKNOWN")).alias("read_name"), F.lit("bad_line").alias("kind"), F.col("error").alias("message"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text (gzip too) in the schema of ``schema.ALIGNMENTS``, read groups joined; lines that are none are left out."""
    return alignments_of(sam_lines(spark, path), read_groups(spark, path))


def _header_lines(batches):
    """The lines up to the first that is no header line."""
    for batch in batches:
        is_head = [v is not None and v.startswith("@") for v in batch.column(0).to_pylist()]
        n = is_head.index(False) if False in is_head else len(is_head)
        yield batch.slice(0, n)
        if n < len(is_head):
            return


def _tags(fields: Column) -> Column:
    """A map of optional fields TAG:TYPE:VALUE."""
    keys = F.transform(fields, lambda t: F.substring(t, 1, 2))
    first = F.filter(fields, lambda t, i: F.array_position(keys, F.substring(t, 1, 2)) == i + 1)
    return F.map_from_entries(F.transform(first, lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, F.lit(6), F.length(t)).alias("value"))))


def first_reads(reads: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` reads in the order in which they are read, all of them without a number: the cap of a trial run.

    Readers give reads in file order, so partitions are read one after the other, more at a time, until there are enough;
    the rest of the file isn't. The driver holds the ``n`` rows.
    """
    return reads.sparkSession.createDataFrame(reads.take(n), reads.schema) if n else reads


def _gtf(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path).filter(~F.startswith("value", F.lit("#"))).withColumn("p", F.split("value", "\t")).filter(F.size("p") >= 9)
    at = lambda i: F.get("p", F.lit(i))
    return rows.select("ord", "value", at(0).alias("chrom"), at(2).alias("feature"), at(3).try_cast("int").alias("s"), at(4).try_cast("int").alias("e"), at(6).alias("strand"), at(8).alias("attributes")).filter("s is not null and e is not null")


def gtf_features(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start0, end0 (half-open, 0-based), gene and file_ord of exons, coding parts, transcripts and genes; gene is the name, else the identifier, else NA."""
    rows = _gtf(spark, path).filter(F.lower("feature").isin("exon", "cds", "transcript", "gene"))
    return rows.select("chrom", (F.col("s") - 1).alias("start0"), F.col("e").alias("end0"), F.coalesce(attribute(F.col("attributes"), "gene_name"), attribute(F.col("attributes"), "gene_id"), F.lit("NA")).alias("gene"), F.col("ord").alias("file_ord"))


def gtf_exons(spark: SparkSession, path: str) -> DataFrame:
    """Exons with a transcript: chrom, strand, tx_id, gene_id (of the transcript's last line), exon_rank by coordinate, s, e (inclusive)."""
    a = F.col("attributes")
    rows = _gtf(spark, path).filter("feature = 'exon'").withColumns({"tx_id": attribute(a, "transcript_id"), "g": attribute(a, "gene_id")}).filter("tx_id is not null")
    rank = F.row_number().over(Window.partitionBy("chrom", "strand", "tx_id").orderBy("s", "e", "ord"))
    gene = F.last("g", ignorenulls=True).over(Window.partitionBy("tx_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumns({"exon_rank": rank, "gene_id": gene}).select("chrom", "strand", "tx_id", "gene_id", "exon_rank", "s", "e")


def is_curated(line: Column) -> Column:
    """Lines with the word 'level 1' and without the words CDS and TEC."""
    word = lambda w: line.rlike(rf"(?<!\w){w}(?!\w)")
    return word("level 1") & ~word("CDS") & ~word("TEC")


def gtf_curated(spark: SparkSession, path: str) -> DataFrame:
    """Curated lines with the attributes that the region builder needs: chrom, feature, s, e, strand, gene, tx_id, tx_name, gene_biotype, tx_biotype, exon_number."""
    a = F.col("attributes")
    rows = _gtf(spark, path).filter(is_curated(F.col("value")))
    return rows.select("chrom", "feature", "s", "e", "strand", F.coalesce(attribute(a, "gene_name"), attribute(a, "gene_id")).alias("gene"), attribute(a, "gene_id").alias("gene_id"), attribute(a, "transcript_id").alias("tx_id"), attribute(a, "transcript_name").alias("tx_name"), attribute(a, "gene_type").alias("gene_biotype"), attribute(a, "transcript_type").alias("tx_biotype"), attribute(a, "exon_number").try_cast("int").alias("exon_number"))


def read_gene_bed(spark: SparkSession, path: str, name_col: int = 4, guess: bool = False) -> DataFrame:
    """Genes of a BED: chrom, start1, end1 (1-based, inclusive), name and file_ord.

    The long-read rule takes the name of column ``name_col`` (from 1), and gene:chrom:start-end (1-based) where that is
    missing or empty. With ``guess``, the short-read rule, a missing name or a strand in its place gives the first of
    columns 4 to 10 that is no strand, no Ensembl identifier and of at most 50 characters, else the first identifier, else
    an empty name; each gene is there twice, with and without chr in front of its chromosome.
    """
    rows = _lines(spark, path).withColumn("p", F.split("value", "\t")).filter((F.size("p") >= 3) & ~F.startswith("value", F.lit("#")))
    at = lambda i: F.get("p", F.lit(i))
    given = F.trim(at(name_col - 1)) if guess else at(name_col - 1)
    start = at(1).try_cast("int") + 1
    if guess:
        others = F.filter(F.transform(F.slice("p", 4, 7), lambda x: F.trim(x)), lambda x: (x != "") & ~x.isin("+", "-"))
        known = lambda x: F.startswith(F.upper(x), F.lit("ENSG"))
        plain, ensembl = F.filter(others, lambda x: ~known(x) & (F.length(x) <= 50)), F.filter(others, known)
        name = F.coalesce(F.when((given != "") & ~given.isin("+", "-"), given), F.get(plain, F.lit(0)), F.get(ensembl, F.lit(0)), F.lit(""))
    else:
        name = F.coalesce(F.when(given != "", given), F.concat(F.lit("gene:"), at(0), F.lit(":"), start.cast("string"), F.lit("-"), at(2)))
    bare = F.regexp_replace(at(0), "^chr", "")
    chrom = F.explode(F.array(bare, F.concat(F.lit("chr"), bare))) if guess else at(0)
    return rows.select(chrom.alias("chrom"), start.alias("start1"), at(2).try_cast("int").alias("end1"), name.alias("name"), F.col("ord").alias("file_ord")).filter("start1 is not null and end1 is not null")


# The columns that tell the two formats apart.
_PER_READ = {"pos_start", "pos_end", "read_name", "sv_type"}
_CLUSTERED = {"pos", "end", "svtype", "length", "support"}


def candidate_format(header: list[str]) -> str:
    """per_read or clustered, by the number of telling columns; a tie is per_read."""
    return "per_read" if len(_PER_READ & set(header)) >= len(_CLUSTERED & set(header)) else "clustered"


def read_candidates(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Candidates of a per-read or clustered table with '#' comments, in the columns of ``schema.CANDIDATES``; ord is file order.

    Only the header line is read on the driver; columns are found by name. '.' and missing optional columns take their defaults: mapq 30,
    length 0, strand +, support 1, details of the read empty, 0 or F/F. A missing read name is read_ and the number of its line behind the
    header, comments and empty lines not counted. An insertion whose end is its start ends behind its length, or behind its base. A row
    with no number where one belongs (positions, length, and for per-read tables read length, template length and the two mate flags) is
    left out; only mapq and support that are no numbers take their defaults. Per-read rows with another number of fields
    than the header are left out; clustered rows are filled up or cut. White space around lines doesn't count.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("value")).filter(~F.startswith("value", F.lit("#")) & (F.col("value") != ""))
    lines = lines.withColumn("ord", F.monotonically_increasing_id())
    top = lines.take(1)
    if not top:
        raise ValueError(f"no header in {path}")
    header = top[0]["value"].split("\t")
    kind = kind or candidate_format(header)
    needed = {"per_read": ["chrom", "pos_start", "pos_end", "sv_type", "sv_len"], "clustered": ["chrom", "pos", "end", "svtype", "length"]}[kind]
    missing = [c for c in [*needed, *(["read_name"] if kind == "per_read" else [])] if c not in header]
    if missing:
        raise ValueError(f"{kind} table without columns {missing}")
    counts = lines.groupBy(F.shiftright("ord", 33).alias("_range")).agg(F.count(F.lit(1)).alias("_k"))
    counts = counts.select("_range", F.coalesce(F.sum("_k").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # a row for each range of the file
    rows = lines.withColumn("_range", F.shiftright("ord", 33)).join(F.broadcast(counts), "_range").withColumn("_line", F.col("_before") + F.col("ord").bitwiseAND((1 << 33) - 1)).filter("_line > 0")
    p = F.split("value", "\t")
    if kind == "per_read":
        rows = rows.filter(F.size(p) == len(header))

    def raw(name: str) -> Column:
        return F.trim(F.get(p, F.lit(header.index(name)))) if name in header else F.lit(None).cast("string")

    def text(name: str, default: str | None = None) -> Column:
        return F.coalesce(F.when(raw(name).isin(".", ""), None).otherwise(raw(name)), F.lit(default))

    def number(name: str) -> Column:
        """0 for '.' and a missing column; null for what is no number."""
        return F.when(F.coalesce(raw(name), F.lit(".")) == ".", F.lit(0)).otherwise(raw(name).try_cast("int"))

    chrom, pos, end, svtype, _ = (text(c) for c in needed)
    pos, end, size, svtype = pos.try_cast("int"), end.try_cast("int"), F.abs(number(needed[4])), F.upper(svtype)
    end = F.when((svtype == "INS") & (pos == end), pos + F.greatest(size, F.lit(1))).otherwise(end)
    per_read = kind == "per_read"
    read = F.coalesce(text("read_name" if per_read else "example_reads"), F.concat(F.lit("read_"), F.col("_line").cast("string")))
    mapq = F.coalesce(text("MAPQ" if per_read else "median_mapq").try_cast("int"), F.lit(30))
    way = strand(text("ORIENTATION", "+")) if per_read else F.lit("+")
    details = {"note": text("note", ""), "read_len": number("read_len"), "cigar": text("cigar", ""), "tlen": number("TLEN"), "mate_unmapped": F.least(F.abs(number("MATE_UNMAPPED")), F.lit(1)), "is_proper_pair": F.least(F.abs(number("IS_PROPER_PAIR")), F.lit(1)), "orientation": text("ORIENTATION", "F/F"), "seq": text("SEQ", "")}
    support = F.coalesce(text("support").try_cast("long"), F.lit(1).cast("long"))
    out = rows.select("ord", chr_name(chrom).alias("chrom"), pos.alias("pos"), end.alias("end"), svtype.alias("svtype"), size.alias("svlen"), read.alias("read"), way.alias("strand"), mapq.alias("mapq"), support.alias("support"), text("genes", "").alias("genes"), text("example_ins_seq", "").alias("ins_seq"), *[c.alias(name) for name, c in details.items()])
    return out.dropna(subset=["chrom", "pos", "end", "svtype", "svlen", "read_len", "tlen", "mate_unmapped", "is_proper_pair"])


def read_regions(spark: SparkSession, path: str, chroms: list[str] | None = None) -> DataFrame:
    """The transcript regions that ``sinks.write_regions`` has put out, of all chromosomes or of these; folders of others aren't read."""
    from ..schema import TX_REGIONS

    rows = spark.read.schema(TX_REGIONS).parquet(path)
    return rows.filter(F.col("chrom").isin(chroms)) if chroms is not None else rows


def _named(spark: SparkSession, path: str, sep: str, needed: list[str]) -> DataFrame:
    """A table with a header, all columns as text, found by name; files whose headers differ are an error."""
    raw = spark.read.csv(path, sep=sep, header=True, enforceSchema=False)
    missing = [c for c in needed if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no columns {missing}")
    return raw


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """The merged table, as ``sinks.write_table`` puts it out, in the columns of ``schema.MERGED``.

    Columns are found by name, so their order doesn't matter and others may be there; what the annotation needs must be there, the rest is
    null where it is missing. Text where a number belongs is an error of the query.
    """
    from ..schema import MERGED

    kinds = [c.strip().rsplit(" ", 1) for c in MERGED.replace("`", "").split(",")]
    raw = _named(spark, path, "\t", ["chrom", "start", "end", "type", "support", "median_sv_len"])
    return raw.select(*[(F.col(f"`{c}`") if c in raw.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds])


def read_sv_csv(spark: SparkSession, path: str) -> DataFrame:
    """Events of a CSV by its column names: sv_id, chrom, start, end (in order), read, svtype, svlen as given.

    Chr, Start and End must be there; the read is Readname(ID), or ID where that is missing or empty; SVType and SVLen may be missing.
    Text where a position belongs is an error of the query.
    """
    raw = _named(spark, path, ",", ["Chr", "Start", "End"])
    given = lambda c: F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")) if c in raw.columns else F.lit(None).cast("string")
    start, end = F.trim("Start").cast("int"), F.trim("End").cast("int")
    return raw.select(F.monotonically_increasing_id().alias("sv_id"), F.trim("Chr").alias("chrom"), F.least(start, end).alias("start"), F.greatest(start, end).alias("end"), F.coalesce(given("Readname(ID)"), given("ID")).alias("read"), given("SVType").alias("svtype"), given("SVLen").alias("svlen"))

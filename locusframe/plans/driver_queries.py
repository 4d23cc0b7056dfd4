"""A query for each operator over the driver's tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar
from ..functions.text import attribute
from ..operators import annotate, cluster, intervals, observe
from ..sinks.text import exon_vcf_lines, merged_table, vcf_lines
from ..sources.text import is_curated
from ..steps import shared_path
from . import projections as P

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_A, _C, _G, _X, _T = (P.duck(x) for x in (P.ALIGNMENTS, P.CANDIDATES, P.GENES, P.EXONS, P.ATTRIBUTES))
_OPS = f"""a AS ({_A}), o1 AS (SELECT *, regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]') AS t FROM a),
o2 AS (SELECT * EXCLUDE (t), unnest(t) AS t, generate_subscripts(t, 1) - 1 AS i, len(t) AS n_ops FROM o1),
o3 AS (SELECT *, right(t, 1) AS op, CAST(left(t, length(t) - 1) AS INT) AS len FROM o2),
ops AS (SELECT *, CAST(coalesce(sum(CASE WHEN op IN ('M','=','X','D','N') THEN len ELSE 0 END) OVER w, 0) AS INT) AS ref, CAST(coalesce(sum(CASE WHEN op IN ('M','=','X','I','S') THEN len ELSE 0 END) OVER w, 0) AS INT) AS rd,
CAST(sum(CASE WHEN op IN ('M','=','X','D','N') THEN len ELSE 0 END) OVER (PARTITION BY read_idx) AS INT) AS span
FROM o3 WINDOW w AS (PARTITION BY read_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_USABLE = "(flag & 1284) = 0 AND mapq >= 20"
_INDELS = f"""{_OPS}, obs AS (SELECT read_idx, CAST(i AS INT) AS obs_idx, chrom, CAST(pos0 + ref + 1 AS INT) AS pos, CASE op WHEN 'I' THEN 'INS' ELSE 'DEL' END AS svtype, len AS length, mapq, qname AS rname, CASE op WHEN 'I' THEN substr(seq, rd + 1, len) END AS seq
FROM ops WHERE {_USABLE} AND op IN ('I', 'D') AND len >= 20)"""
_POLY = "(length(b) >= least(20, n) AND length(b) > 0 AND greatest(length(b) - length(replace(b, 'A', '')), length(b) - length(replace(b, 'T', ''))) >= 0.8 * length(b))"
_CLIPS = f"""{_OPS}, c1 AS (SELECT read_idx, i, chrom, mapq, qname, len AS n, s.side, CAST(CASE s.side WHEN 'L' THEN pos0 + 1 ELSE pos0 + span END AS INT) AS pos, CASE WHEN s.side = 'L' THEN substr(seq, 1, len) ELSE right(seq, len) END AS b
FROM ops, (VALUES ('L'), ('R')) s(side) WHERE {_USABLE} AND op = 'S' AND len >= 20 AND i = CASE s.side WHEN 'L' THEN 0 ELSE n_ops - 1 END),
obs AS (SELECT read_idx, CAST(i * 2 + CASE side WHEN 'R' THEN 1 ELSE 0 END AS INT) AS obs_idx, chrom, pos, side, n AS cliplen, mapq, qname AS rname FROM c1 WHERE NOT {_POLY})"""
_SPLITS = f"""a AS ({_A}), s1 AS (SELECT *, list_filter(list_transform(list_filter(string_split(sa, ';'), lambda x: x <> ''), lambda x: string_split(x, ',')), lambda f: len(f) = 6) AS es FROM a WHERE {_USABLE} AND sa IS NOT NULL),
s2 AS (SELECT * EXCLUDE (es), unnest(es) AS e, generate_subscripts(es, 1) - 1 AS k FROM s1),
s3 AS (SELECT *, CAST(list_sum(list_transform(list_filter(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), lambda x: right(x, 1) IN ('M','=','X','D','N')), lambda x: CAST(left(x, length(x) - 1) AS INT))) AS INT) AS span,
CAST(list_sum(list_transform(list_filter(regexp_extract_all(e[4], '[0-9]+[MIDNSHP=X]'), lambda x: right(x, 1) IN ('M','=','X','D','N')), lambda x: CAST(left(x, length(x) - 1) AS INT))) AS INT) AS span2, CAST(e[2] AS INT) AS p2 FROM s2),
obs AS (SELECT read_idx, CAST(k * 2 + j AS INT) AS obs_idx, chrom AS chrom1, CAST(CASE j WHEN 0 THEN pos0 + span ELSE pos0 + 1 END AS INT) AS pos1, e[1] AS chrom2, CAST(CASE WHEN j = 1 AND span2 > 0 THEN p2 + span2 - 1 ELSE p2 END AS INT) AS pos2, mapq, qname AS rname, chrom = e[1] AS same_chrom, CASE j WHEN 0 THEN 'primaryR->SAstart' ELSE 'primaryL->SAend' END AS note FROM s3, (VALUES (0), (1)) t(j))"""


def _leaders(obs: str, keys: str, fields: str, order: str, match: str) -> str:
    """Clusters by the plain rule: the first row that is left leads and takes every matching one; again with the rest."""
    key = keys.split(", ")
    return f"""{obs}, packed AS (SELECT {keys}, list({{{fields}}} ORDER BY {order}) AS rem FROM obs GROUP BY {keys}),
lead_rec AS (SELECT {keys}, 0 AS step, CAST(NULL AS BIGINT) AS lead_read, list_filter(rem, lambda x: false) AS took, rem FROM packed
UNION ALL SELECT {keys}, step + 1, rem[1].read_idx, list_filter(rem, lambda x: {match}), list_filter(rem, lambda x: NOT ({match})) FROM lead_rec WHERE len(rem) > 0),
led AS (SELECT {", ".join(key)}, step, unnest(took) AS x FROM lead_rec WHERE step > 0)"""


def _med(c: str) -> str:
    return f"CAST(trunc(quantile_cont({c}, 0.5)) AS INT)"


_FIRST3 = "array_to_string(list_slice(list(x.rname ORDER BY {o}), 1, 3), ',') AS example_reads"


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.project(spark, sf_dir, P.CANDIDATES)


def _genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.project(spark, sf_dir, P.GENES)


def _exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.project(spark, sf_dir, P.EXONS)


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.usable(P.alignments(spark, sf_dir))


def _indels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.indels(_usable(spark, sf_dir))


@query(f"WITH {_OPS} SELECT read_idx, CAST(i AS INT) AS i, op, len, ref, rd AS read FROM ops")
def cigar_ops(spark, sf_dir):
    rows = P.alignments(spark, sf_dir).select("read_idx", F.explode(cigar.placed(cigar.ops(F.col("cigar")), lambda x: x["len"] >= 0)).alias("x"))
    return rows.select("read_idx", "x.i", "x.op", "x.len", "x.ref", "x.read")


@query(f"WITH {_OPS} SELECT DISTINCT read_idx, span FROM ops")
def ref_span(spark, sf_dir):
    return P.alignments(spark, sf_dir).select("read_idx", cigar.ref_span(cigar.ops(F.col("cigar"))).alias("span"))


@query(f"WITH {_INDELS} SELECT * FROM obs")
def indel_obs(spark, sf_dir):
    return _indels(spark, sf_dir)


@query(f"WITH {_INDELS} SELECT chrom, svtype, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos, CAST(sum(length) AS BIGINT) AS sum_length FROM obs GROUP BY ALL")
def indel_counts(spark, sf_dir):
    return _indels(spark, sf_dir).groupBy("chrom", "svtype").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("sum_pos"), F.sum("length").alias("sum_length"))


_LEGACY = f"""{_OPS}, lg AS (SELECT read_idx, CAST(i AS INT) AS obs_idx, chrom, CAST(pos0 + ref AS INT) AS start, CAST(pos0 + ref + CASE WHEN op IN ('D', 'N') THEN len - 1 ELSE 0 END AS INT) AS "end", qname AS read_name,
CASE op WHEN 'I' THEN 'INS' WHEN 'D' THEN 'DEL' WHEN 'S' THEN 'SOFTCLIP' ELSE 'LARGE_N' END AS sv_type, len AS sv_len,
CASE WHEN op <> 'S' THEN concat('CIGAR_', op) WHEN i = 0 THEN 'CIGAR_S_left' WHEN i = n_ops - 1 THEN 'CIGAR_S_right' ELSE 'CIGAR_S_internal' END AS note
FROM ops WHERE (flag & 4) = 0 AND mapq >= 20 AND ((op IN ('I', 'D', 'S') AND len >= 30) OR (op = 'N' AND len >= 500))
UNION ALL SELECT read_idx, 1000000, chrom, pos0, CAST(pos0 + span AS INT), qname, 'SPLIT', 0, 'SA_tag' FROM ops WHERE i = 0 AND (flag & 4) = 0 AND mapq >= 20 AND sa IS NOT NULL)"""


def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = observe.usable_legacy(P.alignments(spark, sf_dir))
    return observe.legacy_candidates(reads, large_n=500).select("read_idx", "obs_idx", "chrom", "start", "end", "read_name", "sv_type", "sv_len", "note")


@query(f"WITH {_LEGACY} SELECT * FROM lg")
def legacy_obs(spark, sf_dir):
    return _legacy(spark, sf_dir)


@query(f"WITH {_CLIPS} SELECT * FROM obs")
def clip_obs_polyfilter(spark, sf_dir):
    return observe.clips(_usable(spark, sf_dir), min_clip=20, short_poly=True)


@query(f"WITH {_SPLITS} SELECT * FROM obs")
def sa_splits(spark, sf_dir):
    return observe.splits(_usable(spark, sf_dir))


_PAIR = "SELECT read_idx, {0} AS sv_type, {1} AS sv_len FROM a WHERE (flag & 4) = 0 AND mapq >= 20 AND (flag & 1) <> 0 AND {2}"


@query(f"WITH a AS ({_A}) " + " UNION ALL ".join([_PAIR.format("'MATE_UNMAPPED'", "0", "(flag & 8) <> 0"), _PAIR.format("'DISC_PAIR'", "abs(tlen)", "(flag & 8) = 0 AND (flag & 2) = 0"), _PAIR.format("'LARGE_INSERT'", "abs(tlen)", "(flag & 8) = 0 AND abs(tlen) >= 1500")]))
def discordant_pairs(spark, sf_dir):
    reads = observe.usable_legacy(P.alignments(spark, sf_dir))
    found = observe.legacy_candidates(reads, discordant=True, insert_cutoff=1500)
    return found.filter(F.col("sv_type").isin("MATE_UNMAPPED", "DISC_PAIR", "LARGE_INSERT")).select("read_idx", "sv_type", "sv_len")


@query(f"WITH a AS ({_A}) SELECT CASE WHEN max(CASE WHEN upper(rg_platform) LIKE '%ILLUMINA%' THEN 1 ELSE 0 END) = 1 THEN 'short' WHEN max(CASE WHEN upper(rg_platform) IN ('PACBIO', 'ONT') THEN 1 ELSE 0 END) = 1 THEN 'long' END AS bam_type FROM a")
def bam_type(spark, sf_dir):
    return observe.read_type(P.alignments(spark, sf_dir))


_PLATFORMS = ["Illumina HiSeq", "PacBio", "PACBIO_RS", "PACBIO_SMRT", "PACBIO_HIFI", "ont", "OXFORD_NANOPORE", "NANOPORE", "ULTIMA"]


@query("WITH p AS (SELECT CASE event_id % 9 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_PLATFORMS)) + """ END AS platform FROM events) SELECT platform, CASE WHEN upper(platform) LIKE '%ILLUMINA%' THEN 'short' WHEN upper(platform) IN ('PACBIO', 'PACBIO_RS', 'PACBIO_SMRT', 'PACBIO_HIFI', 'ONT', 'OXFORD_NANOPORE') THEN 'long' END AS bam_type FROM p GROUP BY platform""")
def bam_type_platforms(spark, sf_dir):
    reads = P.alignments(spark, sf_dir)
    of = lambda i, x: observe.read_type(reads.filter(F.col("read_idx") % 9 == i).withColumn("rg_platform", F.lit(x))).select(F.lit(x).alias("platform"), "bam_type")
    return functools.reduce(DataFrame.union, [of(i, x) for i, x in enumerate(_PLATFORMS)])


@query(f"""WITH a AS ({_A}) SELECT read_idx, concat(CASE WHEN (flag & 16) <> 0 THEN 'R' ELSE 'F' END, '/', CASE WHEN (flag & 32) <> 0 THEN 'R' ELSE 'F' END) AS orientation, CAST(length(seq) AS INT) AS read_len, CAST((flag & 8) <> 0 AS INT) AS mate_unmapped, CAST((flag & 2) <> 0 AS INT) AS is_proper_pair
FROM a WHERE (flag & 4) = 0 AND mapq >= 20 AND sa IS NOT NULL""")
def read_details(spark, sf_dir):
    """What the per-read table shows of a read besides its candidates."""
    found = observe.legacy_candidates(observe.usable_legacy(P.alignments(spark, sf_dir)))
    return found.filter("sv_type = 'SPLIT'").select("read_idx", "orientation", "read_len", "mate_unmapped", "is_proper_pair")


@query(f"""WITH {_OPS.replace("FROM a)", "FROM a WHERE read_idx % 6 = 0)", 1)} SELECT read_idx, CAST(i AS INT) AS obs_idx, chrom, CAST(pos0 + ref AS INT) AS start, CAST(pos0 + ref + CASE op WHEN 'D' THEN len - 1 ELSE 0 END AS INT) AS "end", qname AS read_name,
CASE op WHEN 'I' THEN 'INS' WHEN 'D' THEN 'DEL' ELSE 'SOFTCLIP' END AS sv_type, len AS sv_len, concat('SALVAGED_CIGAR_', op) AS note FROM ops WHERE op IN ('I', 'D', 'S') AND len >= 30""")
def salvage_obs(spark, sf_dir):
    """Every sixth read has an operation that doesn't exist at the end of its CIGAR."""
    reads = P.alignments(spark, sf_dir).withColumn("cigar", F.when(F.col("read_idx") % 6 == 0, F.concat("cigar", F.lit("7Q"))).otherwise(F.col("cigar")))
    return observe.salvage(reads)[0]


@query(f"WITH a AS ({_A}), f AS (SELECT length(seq) AS n FROM a WHERE length(seq) > 0 ORDER BY read_idx LIMIT 5000) SELECT CASE WHEN {_med('n')} < 1000 THEN 'short' ELSE 'long' END AS bam_type, {_med('n')} AS median_len, avg(n) AS mean_len, count(*) AS n_reads, 0 AS n_skipped FROM f")
def read_lengths(spark, sf_dir):
    return observe.length_sample(P.alignments(spark, sf_dir))


@query(f"WITH a AS ({_A}), f AS (SELECT read_idx, abs(tlen) AS t FROM a WHERE (flag & 1) <> 0 AND tlen <> 0) SELECT {_med('t')} AS median_tlen, round(avg(t), 4) AS mean_tlen, round(stddev_pop(t), 4) AS std_tlen, count(*) AS n_pairs, (SELECT count(*) FROM a WHERE (flag & 1) <> 0 AND (flag & 8) <> 0 AND tlen = 0) AS n_unmapped, 0 AS n_skipped, greatest(1000, CAST(trunc({_med('t')} + 3 * stddev_pop(t)) AS INT)) AS cutoff FROM f")
def insert_size(spark, sf_dir):
    return observe.insert_sizes(P.alignments(spark, sf_dir), sample=None).withColumns({"mean_tlen": F.round("mean_tlen", 4), "std_tlen": F.round("std_tlen", 4)})


@query(f"""WITH {_LEGACY}, m AS (SELECT *, CASE WHEN start <= max("end") OVER w + 50 THEN 0 ELSE 1 END AS fresh FROM lg WINDOW w AS (PARTITION BY chrom, sv_type ORDER BY start, "end", read_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom, sv_type ORDER BY start, "end", read_name ROWS UNBOUNDED PRECEDING) AS c FROM m)
SELECT chrom, min(start) AS start, max("end") AS "end", sv_type AS type, count(DISTINCT read_name) AS support, {_med('sv_len')} AS median_sv_len, array_to_string(list_sort(list(DISTINCT read_name)), ',') AS reads FROM n GROUP BY chrom, sv_type, c HAVING count(DISTINCT read_name) >= 2""")
def gap_merge(spark, sf_dir):
    return cluster.gap_merge(_legacy(spark, sf_dir)).withColumn("reads", F.array_join("reads", ","))


_NEAR = "abs(x.pos - rem[1].pos) <= 10"
_LIKE = "abs(x.length - rem[1].length) <= greatest(5, greatest(x.length, rem[1].length) // 10)"
_O = "x.pos, x.length, x.read_idx, x.obs_idx"


@query(f"""WITH RECURSIVE {_leaders(_INDELS, "chrom, svtype", "'pos': pos, 'length': length, 'read_idx': read_idx, 'obs_idx': obs_idx, 'mapq': mapq, 'rname': rname, 'seq': seq", "pos, length, read_idx, obs_idx", f"{_NEAR} AND {_LIKE}")},
r AS (SELECT chrom, svtype, {_med('x.pos')} AS pos, {_med('x.length')} AS length, count(*) AS support, {_med('x.mapq')} AS median_mapq, {_FIRST3.format(o=_O)},
coalesce(first(x.seq ORDER BY {_O}) FILTER (WHERE svtype = 'INS' AND x.seq <> ''), '') AS example_ins_seq, count(DISTINCT x.rname) AS support_distinct FROM led GROUP BY chrom, svtype, step)
SELECT chrom, pos, CASE svtype WHEN 'DEL' THEN pos + length - 1 ELSE pos END AS "end", svtype, length, support, median_mapq, example_reads, example_ins_seq, support_distinct FROM r""")
def indel_clusters(spark, sf_dir):
    return cluster.indel_clusters(_indels(spark, sf_dir))


@query(f"""WITH RECURSIVE {_leaders(_CLIPS, "chrom, side", "'pos': pos, 'cliplen': cliplen, 'read_idx': read_idx, 'obs_idx': obs_idx, 'mapq': mapq, 'rname': rname", "pos, read_idx, obs_idx", _NEAR)}
SELECT chrom, {_med('x.pos')} AS pos, side, count(*) AS support, {_med('x.mapq')} AS median_mapq, {_med('x.cliplen')} AS median_cliplen, {_FIRST3.format(o="x.pos, x.read_idx, x.obs_idx")}, count(DISTINCT x.rname) AS support_distinct FROM led GROUP BY chrom, side, step""")
def clip_clusters(spark, sf_dir):
    return cluster.clip_clusters(clip_obs_polyfilter(spark, sf_dir))


_ACROSS = _SPLITS.replace("obs AS (", "every AS (") + ", obs AS (SELECT * FROM every WHERE NOT same_chrom)"


@query(f"""WITH RECURSIVE {_leaders(_ACROSS, "chrom1, chrom2", "'pos1': pos1, 'pos2': pos2, 'read_idx': read_idx, 'obs_idx': obs_idx, 'mapq': mapq, 'rname': rname, 'note': note", "pos1, pos2, read_idx, obs_idx", "abs(x.pos1 - rem[1].pos1) <= 10 AND abs(x.pos2 - rem[1].pos2) <= 10")}
SELECT chrom1, {_med('x.pos1')} AS pos1, chrom2, {_med('x.pos2')} AS pos2, count(*) AS support, {_med('x.mapq')} AS median_mapq, array_to_string(list_sort(list(DISTINCT x.note)), '|') AS notes, {_FIRST3.format(o="x.pos1, x.pos2, x.read_idx, x.obs_idx")}, count(DISTINCT x.rname) AS support_distinct FROM led GROUP BY chrom1, chrom2, step""")
def split_clusters(spark, sf_dir):
    return cluster.split_clusters(sa_splits(spark, sf_dir))


#: The open group by the plain rule, a row at a time for each key.
_SEQUENTIAL = f"""c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chrom, svtype ORDER BY pos, ord) AS rn FROM ({_C}) q),
seq_rec AS (SELECT chrom, svtype, rn, ord, rn AS grp, [{{'p': pos, 'e': "end"}}] AS members FROM c WHERE rn = 1
UNION ALL SELECT c.chrom, c.svtype, c.rn, c.ord, CASE WHEN hit THEN grp ELSE c.rn END, CASE WHEN hit THEN list_append(members, me) ELSE [me] END
FROM (SELECT c.*, s.grp, s.members, {{'p': c.pos, 'e': c."end"}} AS me, len(list_filter(s.members, lambda m: abs(m.p - c.pos) <= 50 AND abs(m.e - c."end") <= 50)) > 0 AS hit FROM seq_rec s JOIN c ON c.chrom = s.chrom AND c.svtype = s.svtype AND c.rn = s.rn + 1) c),
g AS (SELECT c.*, s.grp FROM seq_rec s JOIN c USING (chrom, svtype, rn)),
merged AS (SELECT chrom, first(pos ORDER BY support DESC, rn) AS pos, first("end" ORDER BY support DESC, rn) AS "end", svtype, CAST(sum(support) AS BIGINT) AS support, CAST(trunc(avg(svlen)) AS INT) AS median_sv_len, max(mapq) AS mapq, count(*) AS merged_count,
first("read" ORDER BY support DESC, rn) AS baseline_read, first(support ORDER BY support DESC, rn) AS baseline_support, string_agg(concat_ws(':', chrom, pos, "end"), ',' ORDER BY rn) AS read_positions FROM g GROUP BY chrom, svtype, grp HAVING sum(support) >= 2)"""


@query(f"""WITH RECURSIVE {_SEQUENTIAL} SELECT chrom, pos, "end", svtype, support, median_sv_len, mapq, merged_count, CASE merged_count WHEN 1 THEN baseline_read ELSE concat('merged_', merged_count, '_candidates') END AS "read", read_positions, baseline_read, baseline_support, 0 AS window_expansion FROM merged""")
def sequential_merge(spark, sf_dir):
    return cluster.sequential_merge(_candidates(spark, sf_dir))


@query(f"""WITH RECURSIVE {_SEQUENTIAL}, z AS (SELECT *, row_number() OVER (ORDER BY chrom, pos, "end", svtype, baseline_read) AS rn FROM merged)
SELECT concat('cluster_', CASE WHEN rn < 1000 THEN lpad(CAST(rn AS VARCHAR), 3, '0') ELSE CAST(rn AS VARCHAR) END) AS clusterid, chrom, pos AS start, "end", svtype AS type, support, median_sv_len, read_positions, baseline_read, baseline_support, 0 AS window_expansion FROM z""")
def merged_events(spark, sf_dir):
    return merged_table(cluster.sequential_merge(_candidates(spark, sf_dir)))


@query(f"WITH c AS ({_C}), g AS ({_G}), h AS (SELECT c.ord, string_agg(DISTINCT name, ',' ORDER BY name) AS genes FROM c JOIN g ON c.chrom = g.chrom AND c.pos BETWEEN g.start1 AND g.end1 GROUP BY c.ord) SELECT c.ord, coalesce(genes, '') AS genes FROM c LEFT JOIN h USING (ord)")
def gene_point_strict(spark, sf_dir):
    return intervals.genes_at(_candidates(spark, sf_dir), _genes(spark, sf_dir), "ord").select("ord", "genes")


@query(f"WITH c AS ({_C}), g AS ({_G}), h AS (SELECT c.ord, c.pos, last({{'n': name, 'e': end1}} ORDER BY start1, end1, file_ord) AS g FROM c JOIN g ON c.chrom = g.chrom AND g.start1 <= c.pos GROUP BY c.ord, c.pos) SELECT c.ord, CASE WHEN h.g.e >= c.pos THEN h.g.n ELSE '' END AS genes FROM c LEFT JOIN h USING (ord)")
def gene_point_compat(spark, sf_dir):
    return intervals.genes_at(_candidates(spark, sf_dir), _genes(spark, sf_dir), "ord", compat=True).select("ord", "genes")


@query(f"""WITH c AS ({_C}), g AS ({_G}), h AS (SELECT c.ord, string_agg(DISTINCT name, ',' ORDER BY name) AS genes FROM c JOIN g ON c.chrom = g.chrom AND c.pos < g.end1 AND greatest(c."end", c.pos + 1) > g.start1 - 1 GROUP BY c.ord) SELECT c.ord, coalesce(genes, '') AS genes FROM c LEFT JOIN h USING (ord)""")
def cluster_genes(spark, sf_dir):
    spans = _candidates(spark, sf_dir).withColumnRenamed("pos", "start")
    features = _genes(spark, sf_dir).select("chrom", (F.col("start1") - 1).alias("start0"), F.col("end1").alias("end0"), F.col("name").alias("gene"))
    return intervals.genes_over(spans, features, "ord").select("ord", F.array_join("genes", ",").alias("genes"))


@query(f"""WITH c AS (SELECT ord, pos, greatest("end", pos + 1) AS e FROM ({_C}) q), g AS (SELECT start1 - 1 AS s, end1 + CASE WHEN file_ord % 50 = 0 THEN 150000 ELSE 0 END AS e, name, row_number() OVER (ORDER BY start1, file_ord) AS rk FROM ({_G}) q),
t AS (SELECT c.ord, c.pos, c.e, max(rk) AS n FROM c JOIN g ON g.s < c.e GROUP BY ALL),
h AS (SELECT ord, string_agg(DISTINCT name, ',' ORDER BY name) AS genes FROM t JOIN g ON t.pos < g.e AND g.s < t.e AND rk > n - 1000 GROUP BY ord) SELECT c.ord, coalesce(genes, '') AS genes FROM c LEFT JOIN h USING (ord)""")
def cluster_genes_compat(spark, sf_dir):
    """All features on one chromosome, every fiftieth long: those that start more than 1,000 features in front of a cluster's end are missed."""
    spans = _candidates(spark, sf_dir).withColumnRenamed("pos", "start").withColumn("chrom", F.lit("chr1"))
    far = F.when(F.col("file_ord") % 50 == 0, 150_000).otherwise(0)
    features = _genes(spark, sf_dir).select(F.lit("chr1").alias("chrom"), (F.col("start1") - 1).alias("start0"), (F.col("end1") + far).alias("end0"), F.col("name").alias("gene"), "file_ord")
    return intervals.genes_over(spans, features, "ord", compat=True).select("ord", F.array_join("genes", ",").alias("genes"))


@query(f"""SELECT * FROM ({_C}) WHERE chrom = 'chr2' AND pos <= 60000 AND "end" >= 50000 AND svtype = 'DEL'""")
def region_query(spark, sf_dir):
    return intervals.region_query(_candidates(spark, sf_dir), "chr2", 50000, 60000, "DEL")


@query(f"""SELECT * FROM ({_C}) WHERE chrom = 'chr3' AND pos <= 70000 AND "end" >= 70000""")
def point_query(spark, sf_dir):
    return intervals.point_query(_candidates(spark, sf_dir), "chr3", 70000)


@query(f"""WITH c AS ({_C}) SELECT a.ord AS id, b.ord AS other FROM c a JOIN c b ON a.chrom = b.chrom AND a.svtype = b.svtype AND b.pos <= a."end" + 50 AND b."end" >= greatest(0, a.pos - 50) AND a.ord <> b.ord""")
def self_overlap(spark, sf_dir):
    return intervals.self_overlap(_candidates(spark, sf_dir), 50)


_REGIONS = f"""x AS ({_X}), xl AS (SELECT *, lead(s) OVER (PARTITION BY chrom, tx_id ORDER BY s, e) AS nxt FROM x),
regions AS (SELECT chrom, s AS b, e + 1 AS t, gene, tx_id, 'exon' AS kind, exon_number AS no, tx_name, gene_biotype, tx_biotype FROM x
UNION ALL SELECT chrom, e + 1, nxt, gene, tx_id, 'intron', CASE strand WHEN '+' THEN exon_number ELSE exon_number - 1 END, tx_name, gene_biotype, tx_biotype FROM xl WHERE nxt > e + 1)"""


@query(f"WITH {_REGIONS} SELECT chrom, b AS begin, t AS end_excl, gene, tx_id, kind AS region_kind, no AS region_no FROM regions WHERE kind = 'intron'")
def introns(spark, sf_dir):
    return annotate.transcript_regions(_exons(spark, sf_dir)).filter("region_kind = 'intron'").select("chrom", "begin", "end_excl", "gene", "tx_id", "region_kind", "region_no")


def _annotated(spark: SparkSession, sf_dir: str, stored: bool = False) -> DataFrame:
    regions = annotate.transcript_regions(_exons(spark, sf_dir))
    if stored:
        path = shared_path(spark, "regions")
        regions = annotate.store_regions(regions, "regions_" + path.rsplit("-", 1)[1], int(spark.conf.get("spark.sql.shuffle.partitions")), path)
    bare = F.when(F.col("ord") % 3 == 0, F.regexp_replace("chrom", "^chr", "")).otherwise(F.col("chrom"))
    events = _candidates(spark, sf_dir).select(F.col("ord").alias("sv_id"), bare.alias("chrom"), F.col("pos").alias("start"), "end", "svtype", "svlen", "support")
    return annotate.annotate(events, regions)


#: Every third event comes without chr in front of its chromosome, and gets it.
_ANN = f"""{_REGIONS}, c0 AS (SELECT * REPLACE (CASE WHEN ord % 3 = 0 THEN replace(chrom, 'chr', '') ELSE chrom END AS chrom) FROM ({_C})), c AS (SELECT * REPLACE (CASE WHEN starts_with(chrom, 'chr') THEN chrom ELSE concat('chr', chrom) END AS chrom) FROM c0), hits AS (SELECT c.ord, c.pos, c."end" AS e, r.* FROM c JOIN regions r ON c.chrom = r.chrom AND c.pos < r.t AND r.b < CASE c.svtype WHEN 'DEL' THEN c."end" ELSE c.pos + 1 END AND (c.svtype <> 'DEL' OR c."end" > c.pos)),
f AS (SELECT ord, count(DISTINCT gene) AS genes, bool_or(kind = 'exon' AND pos <= b AND e >= t) AS whole, bool_or(kind = 'intron' AND abs(pos - b) <= 5 AND abs(e - t) <= 5) AS splice, string_agg(DISTINCT gene, ',' ORDER BY gene) AS region,
string_agg(DISTINCT tx_name, ',' ORDER BY tx_name) AS tx_name, string_agg(DISTINCT gene_biotype, ',' ORDER BY gene_biotype) AS gene_biotype, string_agg(DISTINCT tx_biotype, ',' ORDER BY tx_biotype) AS tx_biotype FROM hits GROUP BY ord),
ann AS (SELECT c.ord AS sv_id, c.chrom, c.pos AS start, c."end", c.svtype, c.svlen, c.support, CASE WHEN genes IS NULL THEN 'Intergenic' WHEN svtype = 'DEL' AND genes > 1 THEN 'Gene_Fusion' WHEN svtype = 'DEL' AND whole THEN 'Exonic_Deletion' WHEN svtype = 'DEL' AND splice THEN 'Canonical_Splicing' WHEN svtype = 'DEL' THEN 'Intronic/Novel_Splicing' WHEN genes > 1 THEN 'Insertion_in_Fusion_Region' ELSE 'Intragenic_Insertion' END AS ann_type,
coalesce(region, 'Intergenic') AS region, coalesce(tx_name, 'na') AS tx_name, coalesce(gene_biotype, 'na') AS gene_biotype, coalesce(tx_biotype, 'na') AS tx_biotype FROM c LEFT JOIN f USING (ord) WHERE c.chrom IN (SELECT chrom FROM regions))"""


@query(f"WITH {_ANN} SELECT * FROM ann")
def sv_annotation(spark, sf_dir):
    return _annotated(spark, sf_dir)


@query(f"WITH {_ANN} SELECT * FROM ann")
def sv_annotation_stored(spark, sf_dir):
    """The regions are written once with their bins and read as they lie."""
    return _annotated(spark, sf_dir, stored=True)


@query(f"""WITH {_ANN} SELECT chrom, start, concat_ws(chr(9), chrom, start, '.', 'N', concat('<', svtype, '>'), '.', 'PASS', concat_ws(';', concat('END=', "end"), concat('SVTYPE=', svtype), concat('SVLEN=', svlen), concat('SUPPORT=', support), concat('ANN_TYPE=', ann_type), concat('REGION=', region),
CASE WHEN tx_name <> 'na' THEN concat('TX_NAME=', tx_name) END, CASE WHEN gene_biotype <> 'na' THEN concat('GENE_BIOTYPE=', gene_biotype) END, CASE WHEN tx_biotype <> 'na' THEN concat('TX_BIOTYPE=', tx_biotype) END)) AS value FROM ann""")
def vcf_body(spark, sf_dir):
    return vcf_lines(_annotated(spark, sf_dir))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select(F.col("ord").alias("sv_id"), "chrom", F.col("pos").alias("start"), "end")


@query(f"""WITH c AS ({_C}), x AS ({_X}), h AS (SELECT c.ord, bool_or(c.pos >= x.s AND c."end" <= x.e) AS i FROM c JOIN x ON c.chrom = x.chrom AND c.pos <= x.e AND c."end" >= x.s GROUP BY c.ord) SELECT c.ord AS sv_id, chrom, pos AS start, "end", CASE WHEN i THEN 'exon' WHEN i IS NOT NULL THEN 'exon_partial' ELSE 'intergenic' END AS exon_class FROM c LEFT JOIN h USING (ord)""")
def exon_class(spark, sf_dir):
    return annotate.exon_class(_spans(spark, sf_dir), _exons(spark, sf_dir))


@query(f"""WITH c AS ({_C}), x AS ({_X}), ed AS (SELECT *, 'start' AS edge, s AS place FROM x UNION ALL SELECT *, 'end', e FROM x), h AS (SELECT c.ord, string_agg(concat_ws('|', tx_id, gene_id, concat('exon', exon_rank), edge, place), ',' ORDER BY concat_ws('|', tx_id, gene_id, concat('exon', exon_rank), edge, place)) AS hits FROM c JOIN ed ON c.chrom = ed.chrom AND c.pos <= place + 10 AND c."end" >= place - 10 GROUP BY c.ord) SELECT c.ord AS sv_id, chrom, pos AS start, "end", CASE WHEN hits IS NULL THEN 'no' ELSE 'yes' END AS splice, coalesce(hits, '') AS hits FROM c LEFT JOIN h USING (ord)""")
def splice_hits(spark, sf_dir):
    return annotate.splice_hits(_spans(spark, sf_dir), _exons(spark, sf_dir), window=10).withColumn("hits", F.array_join("hits", ","))


@query(f"""WITH c AS (SELECT *, upper(CASE WHEN ord % 2 = 0 THEN lower(svtype) ELSE svtype END) AS kind, CASE ord % 4 WHEN 0 THEN 'NA' WHEN 1 THEN NULL ELSE CAST(svlen AS VARCHAR) END AS given, CASE WHEN ord % 5 = 0 THEN NULL ELSE read END AS name FROM ({_C})), x AS ({_X}),
h AS (SELECT c.ord, bool_or(c.pos >= x.s AND c."end" <= x.e) AS i FROM c JOIN x ON c.chrom = x.chrom AND c.pos <= x.e AND c."end" >= x.s GROUP BY c.ord),
ed AS (SELECT *, 'start' AS edge, s AS place FROM x UNION ALL SELECT *, 'end', e FROM x),
g AS (SELECT c.ord, string_agg(concat_ws('|', tx_id, gene_id, concat('exon', exon_rank), edge, place), ',' ORDER BY concat_ws('|', tx_id, gene_id, concat('exon', exon_rank), edge, place)) AS hits FROM c JOIN ed ON c.chrom = ed.chrom AND c.pos <= place + 10 AND c."end" >= place - 10 GROUP BY c.ord)
SELECT chrom, pos AS start, concat_ws(chr(9), chrom, pos, coalesce(name, '.'), 'N', concat('<', kind, '>'), '.', 'PASS', concat_ws(';', concat('SVTYPE=', kind), concat('SVLEN=', coalesce(TRY_CAST(given AS INT), CASE kind WHEN 'DEL' THEN -("end" - pos + 1) ELSE "end" - pos + 1 END)),
concat('SUMMARY=', CASE WHEN i THEN 'exon' WHEN i IS NOT NULL THEN 'exon_partial' ELSE 'intergenic' END), concat('SPLICE=', CASE WHEN hits IS NULL THEN 'no' ELSE 'yes' END), 'HITS=' || hits)) AS value FROM c LEFT JOIN h USING (ord) LEFT JOIN g USING (ord)""")
def exon_vcf_body(spark, sf_dir):
    """Types in small letters, lengths that are missing or no numbers, and missing reads among the events."""
    n = F.col("ord")
    events = _candidates(spark, sf_dir).select(n.alias("sv_id"), "chrom", F.col("pos").alias("start"), "end", F.when(n % 2 == 0, F.lower("svtype")).otherwise(F.col("svtype")).alias("svtype"), F.when(n % 4 == 0, "NA").when(n % 4 > 1, F.col("svlen").cast("string")).alias("svlen"), F.when(n % 5 != 0, F.col("read")).alias("read"))
    exons = _exons(spark, sf_dir)
    return exon_vcf_lines(annotate.splice_hits(annotate.exon_class(events, exons), exons, window=10))


@query(f"""WITH c AS ({_C}), g AS ({_G}) SELECT c.ord, EXISTS (SELECT 1 FROM g WHERE g.chrom = c.chrom AND g.start1 <= c."end" + 10 AND g.end1 >= c.pos - 10) AS valid FROM c""")
def truth_validation(spark, sf_dir):
    truth = _genes(spark, sf_dir).select("chrom", F.col("start1").alias("pos"), F.col("end1").alias("end"))
    return intervals.validated(_candidates(spark, sf_dir), truth).select("ord", "valid")


@query(f"WITH {_LEGACY} SELECT sv_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM lg GROUP BY sv_type")
def type_summary(spark, sf_dir):
    return annotate.type_summary(_legacy(spark, sf_dir))


@query(f"WITH c AS ({_C}), u AS (SELECT * FROM c WHERE svtype = 'DEL' UNION ALL SELECT * FROM c WHERE chrom = 'chr1') SELECT chrom, svtype, count(*) AS n FROM u WHERE ord NOT IN (SELECT ord FROM c WHERE mapq < 20) GROUP BY ALL")
def structurer_setops(spark, sf_dir):
    held = intervals.Candidates(_candidates(spark, sf_dir))
    return held.of_type("DEL").merge(held.on("chr1")).remove(held.rows.filter("mapq < 20")).statistics()


@query(f"""SELECT id, regexp_extract(attributes, 'gene_id "([^"]*)"', 1) AS gene_id, nullif(regexp_extract(attributes, 'gene_name "([^"]*)"', 1), '') AS gene_name, regexp_extract(attributes, 'level ([0-9]+)', 1) AS level, 'a' AS tag FROM ({_T})""")
def gtf_attributes(spark, sf_dir):
    a = F.col("attributes")
    return P.project(spark, sf_dir, P.ATTRIBUTES).select("id", *[attribute(a, k).alias(k) for k in ("gene_id", "gene_name", "level", "tag")])


@query(f"SELECT id FROM ({_T}) WHERE NOT regexp_matches(line, '\\bCDS\\b') AND NOT regexp_matches(line, '\\bTEC\\b') AND regexp_matches(line, '\\blevel 1\\b')")
def gtf_curated_filter(spark, sf_dir):
    return P.project(spark, sf_dir, P.ATTRIBUTES).filter(is_curated(F.col("line"))).select("id")

"""Explicit schemas of sources and operators. Coordinates are documented where they are made: pos0 and
``*0`` are 0-based, everything else is 1-based unless an operator says so."""

from __future__ import annotations

ALIGNMENTS = "read_idx bigint, qname string, flag int, chrom string, pos0 int, mapq int, cigar string, tlen int, seq string, tags map<string,string>, rg_platform string"
CANDIDATES = (
    "ord bigint, chrom string, pos int, `end` int, svtype string, svlen int, read string, strand string, mapq int, support bigint, "
    "genes string, ins_seq string, note string, read_len int, cigar string, tlen int, mate_unmapped int, is_proper_pair int, orientation string, seq string"
)
TX_REGIONS = "chrom string, begin int, end_excl int, gene string, tx_id string, region_kind string, region_no int, tx_name string, gene_biotype string, tx_biotype string"
GENES = "chrom string, start1 int, end1 int, name string, file_ord bigint"
EXONS = "chrom string, strand string, tx_id string, gene_id string, exon_rank int, s int, e int"
MERGED = "clusterid string, chrom string, start int, `end` int, type string, support bigint, median_sv_len int, read_positions string, baseline_read string, baseline_support bigint, window_expansion int"

# SAM flag bits.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, SECONDARY, DUPLICATE, SUPPLEMENTARY = 1, 2, 4, 8, 16, 32, 256, 1024, 2048

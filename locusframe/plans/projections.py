"""Deterministic projections of the driver's tables to genomic ones, in SQL that Spark and DuckDB both run.

``{events}`` and ``{part}`` stand for the tables; DuckDB gets their bare names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALIGNMENTS = """SELECT event_id AS read_idx, concat('ev', CAST(event_id AS STRING)) AS qname,
CAST(CASE WHEN event_id % 19 = 0 THEN 1024 WHEN event_id % 23 = 0 THEN 256 WHEN event_id % 29 = 0 THEN 4
  ELSE 1 + CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN event_id % 7 = 0 THEN 8 ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN 16 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 32 ELSE 0 END END AS INT) AS flag,
concat('chr', CAST(user_id % 5 + 1 AS STRING)) AS chrom, CAST((event_id * 7919) % 20000 AS INT) AS pos0, CAST(event_id % 61 AS INT) AS mapq,
concat(CAST(event_id % 40 AS STRING), 'S', CAST(20 + event_id % 30 AS STRING), 'M', CAST(event_id % 45 + 1 AS STRING), CASE WHEN event_id % 2 = 0 THEN 'I' ELSE 'D' END, '50M', CAST(100 + event_id % 900 AS STRING), 'N30M', CAST(event_id % 33 + 1 AS STRING), 'S') AS cigar,
CAST((event_id * 37) % 4000 - 2000 AS INT) AS tlen,
concat(repeat(substr('ACGT', CAST(event_id % 4 + 1 AS INT), 1), 40), repeat('ACGT', 50), CASE WHEN event_id % 3 = 0 THEN repeat('A', 40) ELSE repeat('GC', 20) END) AS seq,
CASE WHEN event_id % 4 = 0 THEN concat('chr', CAST(event_id % 5 + 1 AS STRING), ',', CAST((event_id * 131) % 20000 + 1 AS STRING), ',+,', CAST(10 + event_id % 50 AS STRING), 'S', CAST(20 + event_id % 80 AS STRING), 'M,', CAST(event_id % 61 AS STRING), ',0;', CASE WHEN event_id % 8 = 0 THEN 'bad,1;' ELSE '' END) END AS sa,
CASE WHEN event_id % 2 = 0 THEN 'PACBIO' ELSE 'ONT' END AS rg_platform
FROM {events}"""

CANDIDATES = """SELECT event_id AS ord, concat('chr', CAST(user_id % 5 + 1 AS STRING)) AS chrom, CAST((event_id * 7919) % 100000 + 1 AS INT) AS pos,
CAST((event_id * 7919) % 100000 + 1 + CASE WHEN event_id % 2 = 0 THEN event_id % 90 ELSE 0 END AS INT) AS `end`,
CASE WHEN event_id % 2 = 0 THEN 'DEL' ELSE 'INS' END AS svtype, CAST(event_id % 90 + 1 AS INT) AS svlen, concat('ev', CAST(event_id AS STRING)) AS `read`,
CAST(event_id % 61 AS INT) AS mapq, event_id % 3 + 1 AS support
FROM {events}"""

GENES = """SELECT concat('chr', CAST(p_partkey % 5 + 1 AS STRING)) AS chrom, CAST((p_partkey * 104729) % 200000 + 1 AS INT) AS start1,
CAST((p_partkey * 104729) % 200000 + 1 + p_size * 10 AS INT) AS end1, concat('g', CAST(p_partkey AS STRING)) AS name, p_partkey AS file_ord
FROM {part}"""

#: Eight exons for each transcript, two transcripts for each gene.
EXONS = """SELECT concat('chr', CAST(t % 5 + 1 AS STRING)) AS chrom, CASE WHEN t % 2 = 0 THEN '+' ELSE '-' END AS strand, concat('t', CAST(t AS STRING)) AS tx_id,
concat('g', CAST(t - t % 10 AS STRING)) AS gene, concat('g', CAST(t - t % 10 AS STRING)) AS gene_id, CAST(n + 1 AS INT) AS exon_number, CAST(n + 1 AS INT) AS exon_rank,
CAST((t * 7001) % 190000 + n * 200 + 1 AS INT) AS s, CAST((t * 7001) % 190000 + n * 200 + 1 + p_size AS INT) AS e,
concat('T', CAST(t AS STRING)) AS tx_name, CASE WHEN t % 3 = 0 THEN 'lncRNA' ELSE 'protein_coding' END AS gene_biotype, 'transcript' AS tx_biotype
FROM (SELECT (p_partkey - p_partkey % 8) AS t8, CAST((p_partkey - p_partkey % 8) / 8 AS BIGINT) AS t, p_partkey % 8 AS n, p_size FROM {part}) q"""

ATTRIBUTES = """SELECT p_partkey AS id, concat('chr', CAST(p_partkey % 5 + 1 AS STRING), ' HAVANA ', CASE WHEN p_partkey % 4 = 0 THEN 'CDS' ELSE 'exon' END, ' ', attributes) AS line, attributes
FROM (SELECT p_partkey, concat('gene_id "ENSG', CAST(p_partkey AS STRING), '"; gene_type "', CASE WHEN p_partkey % 7 = 0 THEN 'TEC' ELSE 'lncRNA' END, '"; ', CASE WHEN p_partkey % 3 = 0 THEN concat('gene_name "', p_brand, '"; ') ELSE '' END, 'level ', CAST(p_partkey % 12 AS STRING), '; tag "a"; tag "b";') AS attributes FROM {part}) q"""


def project(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "part") if f"{{{t}}}" in sql}
    return spark.sql(sql, **tables)


def duck(sql: str) -> str:
    """The projection for DuckDB."""
    return sql.replace("{events}", "events").replace("{part}", "part").replace("`", '"')


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = project(spark, sf_dir, ALIGNMENTS)
    return rows.withColumn("tags", F.when(F.col("sa").isNotNull(), F.create_map(F.lit("SA"), F.col("sa")))).drop("sa")

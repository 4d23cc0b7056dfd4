"""Observations of reads as they arrive.

The generators work inside the row, so they run unchanged on an unbounded table, without state or watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schema
from ..operators import observe


def indel_stream(spark: SparkSession, path: str, min_mapq: int = 20, min_ins: int = 20, min_del: int = 20) -> DataFrame:
    """Insertions and deletions of the alignment Parquet files that appear in a folder."""
    reads = spark.readStream.schema(schema.ALIGNMENTS).parquet(path)
    return observe.indels(observe.usable(reads, min_mapq), min_ins, min_del)

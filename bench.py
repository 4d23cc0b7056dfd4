"""Times the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the threads."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

QUERIES = ["cigar_ops", "indel_counts", "legacy_obs", "clip_obs_polyfilter", "sa_splits", "gap_merge", "indel_clusters", "clip_clusters", "split_clusters", "sequential_merge", "gene_point_strict", "self_overlap", "sv_annotation", "vcf_body", "exon_class", "splice_hits", "truth_validation", "type_summary"]


def main() -> None:
    from locusframe import registry

    cpus, data = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["ref_span"](spark, data).write.format("noop").mode("overwrite").save()  # starts the JVM's readers and compiler
    took = {}
    for name in QUERIES:
        began = time.time()
        registry.QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(data.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

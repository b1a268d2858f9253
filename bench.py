"""Time the headline queries once each and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from audit_queries import catalog

HEADLINES = (
    "missing_values", "duplicates", "duplicates_lineitem", "constant_columns", "near_constant_columns", "potential_identifiers",
    "identifiers_documents", "high_cardinality_categories", "numeric_outliers", "outliers_lineitem", "outliers_events",
    "category_consistency", "category_documents", "category_documents_dirty", "data_type_warnings", "value_frequencies",
    "scan_csv", "file_manifest", "trim_conversations", "score_table", "audit_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["missing_values"](spark, sf_dir).collect()  # start the JVM's work once
    times = {}
    for name in HEADLINES:
        catalog.forget_audits()  # every report query pays for its own audit
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

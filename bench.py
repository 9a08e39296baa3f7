"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from seqloom.catalog import QUERIES
from seqloom.session import get_spark

# One query per operator family, each over whole tables. Set BENCH_QUERIES to run others.
HEADLINE = (
    "lmer_spectrum lmer_count kmer_index edges contig_start component_sizes contigs "
    "part_supplier_components scan_exclusive scan_multi scan_segmented sort_radix compact spmv "
    "list_rank tridiagonal suffixes hash_probe hash_multivalue"
)


def main() -> None:
    place = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", HEADLINE).split()
    spark = get_spark(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    spent = {}
    for name in names:
        begun = time.perf_counter()
        QUERIES[name](spark, place).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - begun, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": os.path.basename(place.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

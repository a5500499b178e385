"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
All rows of a query are produced (noop sink). The first query runs once more beforehand to warm
the session; each query is then timed once.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "dense_bin_share",
    "point_in_interval_join",
    "interval_overlap_join",
    "merge_intervals",
    "pair_mates",
    "coverage_profile",
    "methylation_features",
    "zscore_vs_panel",
    "base_coverage",
    "expand_alignment",
    "roc_curve",
    "resolve_alleles",
    "feature_table",
    "pack_sequences",
]
#: Test inputs that the queries derive first; timed alone so that an operator's own share shows.
INPUTS = ["aligned", "loci", "reads"]


def main() -> None:
    from fragx.catalog import queries
    from fragx.fixtures import table
    from fragx.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered, times = queries(), {}
    names = sys.argv[1:] or HEADLINE
    registered[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        began = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    inputs = {}
    for name in [] if sys.argv[1:] else INPUTS:
        began = time.perf_counter()
        table(spark, sf_dir, name).write.format("noop").mode("overwrite").save()
        inputs[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "inputs": inputs,
             "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from fieldloom.session import build_session
from workload.catalog import QUERIES

HEADLINE = [
    "composite_on_high_index",
    "seasonal_composite",
    "threshold_dates",
    "zonal_dft",
    "wave_envelope",
    "wave_coefficients",
    "event_table",
    "yday_anomaly",
    "zonal_anomaly",
    "running_mean",
    "index_sam",
    "index_zw3",
    "composite_significance",
    "phase_histogram",
    "sparse_weight_regrid",
    "rotated_wind",
    "vorticity",
    "eof_field",
    "interval_join",
    "asof_select",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the engine before timing
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

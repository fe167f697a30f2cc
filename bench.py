"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local cores. Each query runs once
to warm up and is then timed; `first` holds the cold times. `corpus` reports rows and
megabytes of text per second for one pass over all packs and for one job per pack.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from warpsift.operators.scan import explode_hits, scan_files
from warpsift.plans.queries import QUERIES
from warpsift.rules.catalog import FILE_PACKS
from warpsift.session import build_session
from warpsift.sources import corpus

HEADLINE = ("pack_secrets", "pack_owasp", "pack_db", "pack_prompts", "pack_routes",
            "security_grade", "all_findings", "dependency_scan", "known_vulnerabilities",
            "hallucinated_package", "report_rollup", "remediation_queue", "context_window",
            "apply_fixes", "commit_gate", "required_files_check", "watch_batch_summary")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(make) -> float:
    start = time.perf_counter()
    run(make())
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def one_pass():
        files = corpus.files(spark, sf_dir)
        return explode_hits(scan_files(files, FILE_PACKS), FILE_PACKS)

    first, warm = {"single_pass": timed(one_pass)}, {}
    warm["single_pass"] = timed(one_pass)
    for name in HEADLINE:
        make = lambda: QUERIES[name](spark, sf_dir)  # noqa: B023, E731
        first[name] = timed(make)
        warm[name] = timed(make)

    def per_pack(pack):
        files = corpus.files(spark, sf_dir)
        return timed(lambda: explode_hits(scan_files(files, [pack]), [pack]))

    apart = round(sum(per_pack(p) for p in FILE_PACKS), 3)
    rows, size = corpus.files(spark, sf_dir).selectExpr(
        "count(*)", "sum(octet_length(content)) / 1e6").first()
    rate = {name: {"sec": sec, "rows_per_sec": round(rows / sec), "mb_per_sec":
                   round(size / sec, 2)}
            for name, sec in (("single_pass", warm["single_pass"]), ("one_job_per_pack", apart))}
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, warm", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "sf": (re.findall(r"sf([\d.]+)", sf_dir) or [sf_dir])[-1],
        "first": first, "corpus": rate}))


if __name__ == "__main__":
    sys.exit(main())

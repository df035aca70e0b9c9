"""Headline queries, one JSON line: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS.

The derived tree is written once (timed as ``corpus_build``); the queries then
scan it from storage, the way a source tree is scanned.  Each query is run
``BENCH_RUNS`` times and the best time counts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.operators import deadfiles, graph, includes, scan, summary  # noqa: E402
from riskloom.operators.rules import SPAN_SQL_INJECTION  # noqa: E402
from riskloom.session import build_session, materialize  # noqa: E402
from riskloom.workload.corpus import source_files  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    started = time.perf_counter()
    files = source_files(spark, SF_DIR)
    times["corpus_build"] = time.perf_counter() - started
    listing = files.select("path")

    def run(name, build):
        best = None
        for _ in range(RUNS):
            begun = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - begun
            best = took if best is None else min(best, took)
        times[name] = best

    for profile in ("line", "span", "block"):
        run(f"scan_content_{profile}", lambda p=profile: scan.scan_content(files, p))
    texts = scan.decoded(scan.custom_files(files, "span"), "span")
    run("taint_scan", lambda: scan.run_rules(texts, [SPAN_SQL_INJECTION], "span"))
    run("dead_files", lambda: deadfiles.scan_names(listing, "block"))
    run("severity_summary", lambda: summary.count_by_severity(scan.scan_content(files, "line", "HIGH")))
    run("sorted_findings", lambda: summary.sort_findings(scan.scan_content(files, "line"), "line"))
    run("include_edges", lambda: includes.include_edges(files, "line"))
    nodes = materialize(includes.include_nodes(listing, "line"))
    edges = materialize(includes.include_edges(files, "line"))
    run("top_hubs", lambda: graph.top_hubs(nodes, edges))
    run("orphans", lambda: graph.orphan_files(nodes, edges, "line"))
    run("cycles", lambda: graph.include_cycles(edges))
    run("leaks_documents", lambda: _leaks(spark))

    found = re.search(r"sf([0-9.]+)", SF_DIR)
    scanned = {k: round(v, 3) for k, v in times.items()}
    total = sum(v for k, v in times.items() if k != "corpus_build")
    print(
        json.dumps(
            {
                "metric": "total query time",
                "value": round(total, 3),
                "unit": "sec",
                "queries": scanned,
                "files": files.count(),
                "sf": float(found.group(1)) if found else None,
            }
        )
    )


def _leaks(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    return scan.scan_leaks(docs.select(F.col("doc_id").cast("string").alias("path"), "text"))


if __name__ == "__main__":
    main()

"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import registered
from trustlens.plans.scoring import score_channels
from trustlens.session import build_session
from trustlens.sources.samples import SampleTables, as_of

HEADLINE = {
    "score_channels": None,
    "metrics": "AGG-10",
    "forensics": "AGG-22",
    "conviction": "FRD-15",
    "private_links": "AGG-18",
    "footers": "AGG-31",
    "prompt_corpus": "FLT-18",
    "links": "SET-01",
    "discovery": "JOIN-10",
    "neighbour_risk": "JOIN-09",
    "queue_positions": "WIN-09",
    "latest_favorites": "WIN-07",
    "usage_funnel": "AGG-29",
    "rescore_bulk": "RSC-06",
    "rescore_diff": "RSC-05",
    "channel_details": "PRS-03",
    "import_rows": "SRC-07",
    "answers": "JSN-02",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    queries = registered()

    def run(name: str) -> float:
        tables = SampleTables(spark, folder)
        started = time.perf_counter()
        if name == "score_channels":
            frame = score_channels(tables.posts_with_text, tables.channels, tables.audience, as_of())
        else:
            frame = queries[HEADLINE[name]](tables)
        frame.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    run("metrics")  # start-up of the JVM and of code generation is not timed
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

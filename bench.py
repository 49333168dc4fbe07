"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from kgspark.plans import catalog  # noqa: E402
from kgspark.session import local_session  # noqa: E402

HEADLINES = [
    "link_status_counts", "find_matches", "kg_evidence", "search_fuzzy", "contains_search", "search_containment",
    "build_entity_dict", "relation_edges", "two_hop_labels", "kg_stats", "clean_text", "chunk_text", "tokenize_spans",
    "parse_responses", "locate_mention", "decode_bio", "tag_iob", "assign_occurrences", "stage_entities",
    "emit_relation_triples", "entity_scorecard", "relation_scorecard", "bulk_review_entities", "entity_review_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("link_status_counts")  # starts the JVM's compiler and the Python workers
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()

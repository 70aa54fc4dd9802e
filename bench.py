"""Times queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``python bench.py [name ...]`` times only the named queries. Each runs once, in one session warmed up on
the smallest tables, and writes its rows to Spark's no-op sink, so no result is pulled to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docquarry.plans import registry  # noqa: E402
from docquarry.plans import standins as given  # noqa: E402
from docquarry.plans.ask import answer_questions  # noqa: E402
from docquarry.session import build_session  # noqa: E402

HEADLINE = [
    "build_passage_table",
    "answer_questions",
    "semantic_top_k",
    "semantic_top_k_blocks",
    "scoped_search",
    "embed_chunks",
    "term_search",
    "extractive_summaries",
    "chunk_documents",
    "sources_per_conversation",
    "part_manifest",
    "plan_parts",
    "validate_uploads",
    "initialize_uploads",
    "append_documents",
    "monthly_quota",
    "latest_document_state",
    "refresh_sessions",
    "document_status_counts",
    "upsert_accounts",
    "stream_quota",
    "cell_search",
    "search_postings",
    "search_indexed_names",
    "lookup_stored_keys",
    "upsert_stored_accounts",
    "sketched_totals",
    "markdown_sections",
    "csv_passages",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "docquarry-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="docquarry-bench-"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    names = sys.argv[1:] or HEADLINE
    built = {}

    def build(folder: str) -> None:
        built[folder] = registry.passage_table(spark, folder)

    def answer(folder: str):
        passages, weights = built[folder] if folder in built else registry.passage_table(spark, folder)
        documents = given.table(spark, folder, "documents")
        return answer_questions(given.all_questions(spark, folder), passages, weights, documents, k=5, title="source")

    def run(name: str, folder: str) -> None:
        """The passage table is built once, and answers come from it."""
        if name == "build_passage_table":
            build(folder)
        else:
            rows = answer(folder) if name == "answer_questions" else registry.QUERIES[name](spark, folder)
            rows.write.format("noop").mode("overwrite").save()

    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in names:
            run(name, small)
    seconds = {}
    for name in names:
        start = time.perf_counter()
        run(name, sf_dir)
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
    }))


if __name__ == "__main__":
    main()

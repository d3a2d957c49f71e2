"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from notewright.plans.queries import REGISTRY  # noqa: E402
from notewright.session import build_session  # noqa: E402

HEADLINE = (
    "assemble_dialogues",
    "chunk_turns",
    "tokenize",
    "split_sections",
    "tag_lexicon",
    "parse_entities",
    "dedup_entities",
    "adaptive_threshold",
    "promote_chief",
    "mark_negated",
    "normalize_concept",
    "render_prompts",
    "merge_reconciled",
    "bm25_idf",
    "bm25_topk",
    "bm25_topk_dialogues",
    "vector_topk",
    "hybrid_topk",
    "nearest_other",
    "raft_report",
    "bleu",
    "rouge_n",
    "rouge_l",
    "meteor_exact",
    "section_rouge",
    "entity_prf",
    "usefulness",
    "keyword_coverage",
    "hallucination_rate",
    "sweep_report",
    "best_of_n",
    "full_report",
    "verify_notes",
    "apply_correction",
    "verification_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up of the JVM and of the Python workers is not part of any query.
    REGISTRY["length_stats"](spark, sf_dir).collect()
    REGISTRY["meteor_exact"](spark, sf_dir).collect()

    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        begin = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

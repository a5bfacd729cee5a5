"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line: for each the median of three runs after a first one."""

import json
import os
import statistics
import time

from touchline.plans import registry
from touchline.session import local_session

HEADLINE = ["passing_profile", "attacking_profile", "style_profile_team_match", "percentiles", "possession_states", "score_difference", "neighbours_rms", "role_fit_rank", "probability_metrics", "leaderboard_completion", "url_dedupe_select", "trace_summary", "pr_auc", "feature_variation", "neighbour_stability"]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench", memory="16g")
    queries = registry.queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executors
    took = {}
    for name in HEADLINE:
        seconds = []
        for _ in range(RUNS + 1):
            began = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.time() - began)
        took[name] = round(statistics.median(seconds[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf_dir.rstrip("/").rpartition("sf")[2] or 0)}))


if __name__ == "__main__":
    main()

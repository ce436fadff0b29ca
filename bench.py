"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores. The four stages the
published numbers name (load, diversity, collapse, localisation) come first. Before timing, the
stages run once on the smallest data, so that compiling classes is not part of a stage.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline import catalog  # noqa: E402, F401
from plumbline.registry import QUERIES  # noqa: E402
from plumbline.session import local_session  # noqa: E402

STAGES = {"load": "src_08_metadata", "diversity": "agg_14_overall_diversity", "collapse": "cd_32_scorecard", "localise": "lcz_04_impact"}
READS = {"load": "orders", "diversity": "lineitem", "collapse": "lineitem", "localise": "orders"}
HEADLINE = [
    *STAGES.values(), "agg_01_column_stats", "agg_03_dataset_profile", "agg_11_correlation_matrix", "cd_01_ks", "cd_05_kl_divergence", "cd_06_distribution_fidelity", "cd_12_mutual_information",
    "cd_16_loss_landscape", "cd_17_power_spectrum", "cd_22_chi_square", "cd_24_mann_whitney", "cd_27_overall", "lcz_10_problem_regions", "jon_08_exact_search",
    "jon_09_approximate_search", "sig_06_match_judgement", "smp_02_stratified_sample", "agg_17_usage", "agg_18_history_trends", "srt_03_recent_per_owner", "rec_08_greedy_plan",
    "rec_13_plan_summary", "cas_02_patience", "str_04_sliding_rates", "str_05_failure_streaks", "str_02_rate_limit", "doc_11_spearman", "snk_03_upsert",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in STAGES.values():
        QUERIES[name](spark, small if os.path.isdir(small) else sf_dir).collect()
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        # the noop sink runs the whole plan and keeps the rows on the executors
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    # each stage is set against the rows of the table it reads
    counts = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in set(READS.values())}
    stages = {k: times[v] for k, v in STAGES.items() if v in times}
    per_stage = {k: round(counts[READS[k]] / s) for k, s in stages.items()}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "stages": stages,
        "rows": counts, "rows_per_sec": per_stage, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()

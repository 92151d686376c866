"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tideline.plans import CATALOG  # noqa: E402
from tideline.session import local_session  # noqa: E402

HEADLINE = ("resample_bars", "rolling_zscore", "ema", "asof_backward", "state_runs", "run_smoothing", "event_scatter_locf",
            "winsor_apply", "hmm_decode_causal", "hmm_viterbi", "hmm_restarts", "forward_return_stats", "percentile_table",
            "roc_auc", "kruskal_wallis", "outlier_events", "persistence_label", "lr_walk_forward", "stream_running_duration")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    CATALOG["log_return_n"](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM and workers
    times = {}
    for name in HEADLINE:
        t = time.time()
        CATALOG[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

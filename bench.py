"""Wall time of the headline queries; prints one JSON line.

The session is warm: every query has run once on the smallest tables next to the measured
ones (where they exist), so that class loading and code generation are not timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardline.catalog import load  # noqa: E402
from wardline.session import local_session  # noqa: E402

HEADLINE = ("dedupe_rows", "lookup_first", "first_per_key", "repeat_rows", "covered_days", "length_of_stay",
            "drug_courses", "readmission_chain", "within_flags", "follow_up_inpatient", "charlson", "table_one_stratified",
            "table_one_weighted", "balance_table", "att_weights_three_arms", "survey_logit", "logit_adjusted",
            "neg_binomial_exposure", "kaplan_meier", "pairwise_logrank", "cox", "ph_test", "augment", "outpatient_cohort",
            "inpatient_cohort", "readmission_odds")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    queries, _ = load()
    times = {}
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in HEADLINE:
            queries[name](spark, small).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

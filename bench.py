"""Time the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from checks.operators import OPERATORS
from checks.registry import QUERIES
from vitalrates.session import build_session

HEADLINE = (
    "Q1_population_density", "Q2_cone_counts", "Q3_litter_training_rows", "Q4_litter_facts", "Q5_clean_trials",
    "Q6_imputed_birth_dates", "Q7_survival_facts", "Q8_density_on_trials", "Q9_behaviour_scores",
    "Q10_autumn_survival", "Q11_days200_survival", "T1_survival_rates", "M9_tuning", "W1_group_zscores", "A6_medians",
    "F7_repeat_trials", "U1_union_distinct",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    every = {**QUERIES, **OPERATORS}
    chosen = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    every["Q1_population_density"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in chosen:
        start = time.perf_counter()
        try:
            every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # one failing query must not hide the times of the others
            errors[name] = f"{type(e).__name__}: {str(e)[:300]}"
            continue
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale.group(1)) if scale else None, **({"errors": errors} if errors else {}),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

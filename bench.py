"""Headline timings: prints one JSON line.

Each query runs on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]`` and is fully evaluated. The
stored wardrobe tables (the derived garments and ratings) are timed as ``derive_tables``.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from perchero.plans.catalog import registered
from perchero.sources.testdata import load

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "garment_apply_changes", "garments_generate", "ratings_dedupe", "full_features",
    "feature_matrix", "rule_bonus", "expert_rating", "avoid_skipped_count", "candidate_triples",
    "score_requests", "best_outfit", "top3_outfits", "recommend_response", "context_normalize",
    "stratified_folds", "baseline_metrics", "category_vocab", "prediction_histogram",
    "ml_train_metrics",
]


def evaluate(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    width = max(8, int(CPUS))
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("perchero-bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(width))
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="perchero-bench-"))
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = load(spark, SF_DIR)
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.time()
        run()
        seconds[name] = round(time.time() - start, 3)

    timed("derive_tables", lambda: (tables.garments, tables.ratings))
    built = registered()
    for name in HEADLINE:
        timed(name, lambda: evaluate(built[name](spark, SF_DIR)))
    print(json.dumps({
        "metric": "total wall-clock of the headline queries",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with the median seconds of three runs of each."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from rasterloom.plans import catalogue

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["quantised_run_statistics", "voxel_agg", "change_points", "apply_gradients", "dct_topk", "bilateral", "gauss3", "mse_psnr", "lab_convert", "rle"]


def main() -> None:
    conf = {"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{CPUS}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in NAMES:
        runs = []
        for _ in range(3):
            began = time.time()
            catalogue.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        seconds[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

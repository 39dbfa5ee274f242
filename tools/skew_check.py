"""Measure how a hot run is spread over tasks, from Spark's event log.

Derives a skewed copy of the stage metrics from the given events table (every
third event is assigned to one hot run, so that run holds a third of all
rows), then runs the running totals (W1) twice: with the bucketed scan of
``plans/scan.py`` and with a plain ``Window.partitionBy(run_id)``.  For each
run it reads the event log (written to a fresh scratch folder) and reports,
per shuffle stage, the number of tasks and the largest share of the stage's
shuffle records that a single task read.

Usage: python tools/skew_check.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from flowmetrics.plans.scan import prefix_scan  # noqa: E402


def skewed_metrics(spark: SparkSession, sf_dir: str):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.selectExpr(
        "CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS run_id", "event_id", "ts",
        "CAST(round(value * 100) AS BIGINT) AS tokens_used",
        "CAST(CAST(round(value * 100) AS BIGINT) * CAST(0.000009 AS DECIMAL(12,9)) AS DECIMAL(18,9)) AS cost",
        "NOT (event_type = 'error' AND event_id % 2 = 0) AS tests_pass",
        "CAST(event_type AS STRING) AS stage")


def bucketed(m):
    return prefix_scan(m, ["run_id"], ["ts", "event_id"], [
        ("seq", "count", F.lit(1)), ("cum_tokens", "sum", F.col("tokens_used")), ("cum_cost", "sum", F.col("cost"))],
        target_rows=2000)


def plain(m):
    w = Window.partitionBy("run_id").orderBy("ts", "event_id")
    m = m.withColumn("seq", F.row_number().over(w))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return m.select("run_id", "seq", "stage", F.sum("tokens_used").over(run).alias("cum_tokens"),
                    F.sum("cost").over(run).alias("cum_cost"))


def stage_report(log_dir: str):
    files = [f for f in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)
             if os.path.isfile(f)]
    tasks: dict[int, list[int]] = {}
    for path in files:
        with open(path) as fh:
            for line in fh:
                e = json.loads(line)
                if e.get("Event") != "SparkListenerTaskEnd":
                    continue
                m = e.get("Task Metrics") or {}
                recs = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                if recs:
                    tasks.setdefault(e["Stage ID"], []).append(recs)
    out = []
    for sid, recs in sorted(tasks.items()):
        total = sum(recs)
        out.append({"stage": sid, "tasks": len(recs), "records": total,
                    "max_task_share": round(max(recs) / total, 3)})
    return out


def run(sf_dir: str, variant: str) -> list[dict]:
    log_dir = tempfile.mkdtemp(prefix=f"run-skew-{variant}-")
    spark = (SparkSession.builder.master("local[8]").appName(f"skew-{variant}")
             .config("spark.sql.shuffle.partitions", "64")
             .config("spark.sql.adaptive.enabled", "false")   # show the raw partitioning
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.compress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    m = skewed_metrics(spark, sf_dir)
    (bucketed(m) if variant == "bucketed" else plain(m)).write.format("noop").mode("overwrite").save()
    spark.stop()
    return stage_report(log_dir)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    res = {v: run(sf_dir, v) for v in ("bucketed", "plain")}
    worst = {v: max((s["max_task_share"] for s in st if s["records"] > 1000), default=0.0)
             for v, st in res.items()}
    print(json.dumps({"worst_task_share": worst, "stages": res}))


if __name__ == "__main__":
    main()

"""flowmetrics: Spark-native analytics over the telemetry of automated,
multi-stage development runs (stage metrics, test logs, git status text,
approval gates, snapshots, command logs).

Every operator is DataFrame(s) in, DataFrame out.  Per-run ordered work goes
through :mod:`flowmetrics.plans.scan`, which splits each run into ordered
buckets so that one hot run never lands whole in a single task.
"""

__version__ = "0.1.0"

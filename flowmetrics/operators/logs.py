"""Log-to-table jobs (C1-C8): raw test logs and git text to fact rows.

Parsing is column expressions only (``from_json`` with a corrupt-record
field, ``regexp_extract``, ``regexp_count``), so it stays inside whole-stage
codegen with no Python worker.  Dialect parsers are registered by name (the
test-runner extension point, U1): ``fn(output, return_code) -> struct``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.testlogs import (DIALECTS, NO_FRAMEWORK, NPM_SCHEMA, _result, coverage_of,  # noqa: F401
                                  npm_coverage, npm_json, parse_cargo, parse_go, parse_npm, parse_pytest,
                                  register_dialect, vectorised)

def parse_test_logs(logs: DataFrame, dialects: dict | None = None) -> DataFrame:
    """Dispatch by framework (case-insensitive) in one ``when`` chain; no or
    unknown framework -> the one detected for the project (C6), in an optional
    ``detected_framework`` column; without one failed 0/0/1 "No supported test
    framework detected"; an optional boolean ``tool_missing`` column gives 0/0/1
    "<tool> not found"."""
    dialects = dict(dialects or DIALECTS)
    fw = _framework(logs, dialects)
    out, rc = F.col("output"), F.col("return_code")
    if dialects.get("npm") is parse_npm:
        # parse the JSON once per npm row (a CASE branch would repeat it per field)
        logs = logs.withColumn("_npm_json", F.when(fw == "npm", npm_json(out)))
        dialects["npm"] = lambda o, r: parse_npm(o, r, F.col("_npm_json"))
    res = None
    for name, fn in dialects.items():
        # a batch parser runs before the chain: it gets its own logs only
        own = F.when(fw == name, out) if getattr(fn, "vectorised", False) else out
        res = (F.when(fw == name, fn(own, rc)) if res is None
               else res.when(fw == name, fn(own, rc)))
    none = _result(F.lit(False), F.lit(0), F.lit(0), F.lit(1), F.array(F.lit(NO_FRAMEWORK)))
    res = res.otherwise(none)
    if "tool_missing" in logs.columns:
        missing = _result(F.lit(False), F.lit(0), F.lit(0), F.lit(1),
                          F.array(F.concat(fw, F.lit(" not found"))))
        res = F.when(F.col("tool_missing") & fw.isin(list(dialects)), missing).otherwise(res)
    keep = [c for c in ("run_id", "duration_ms", "ts") if c in logs.columns]
    r = logs.select(*keep, fw.alias("framework"), res.alias("r"))
    return r.select(*keep, "framework", "r.success", "r.total_tests", "r.passed", "r.failed",
                    "r.errors", "r.coverage")


def _framework(logs: DataFrame, dialects: dict):
    given = F.lower(F.col("framework"))
    if "detected_framework" not in logs.columns:
        return given
    return F.when(given.isin(list(dialects)), given).otherwise(
        F.coalesce(F.lower(F.col("detected_framework")), given))


def with_detected(logs: DataFrame, detected: DataFrame) -> DataFrame:
    """Logs of a project with the framework that C6 found for it."""
    d = detected.select("project_id", F.col("framework").alias("detected_framework"))
    return logs.join(d, "project_id", "left")


def test_coverage(logs: DataFrame, dialects: dict | None = None) -> DataFrame:
    """Coverage per test log without the counting work: the dispatch of
    ``parse_test_logs`` over each dialect's coverage alone, so no count pattern
    is in the plan."""
    dialects = dict(dialects or DIALECTS)
    fw, out, rc = _framework(logs, dialects), F.col("output"), F.col("return_code")
    coverage = F.lit(None).cast("double")
    for name, fn in dialects.items():
        own = F.when(fw == name, out) if getattr(fn, "vectorised", False) else out
        coverage = F.when(fw == name, coverage_of(fn)(own, rc)).otherwise(coverage)
    if "tool_missing" in logs.columns:
        coverage = F.when(~F.coalesce("tool_missing", F.lit(False)), coverage)
    keep = [c for c in ("run_id", "duration_ms", "ts") if c in logs.columns]
    return logs.select(*keep, fw.alias("framework"), coverage.alias("coverage"))


def test_rollup(results: DataFrame) -> DataFrame:
    """C5 roll-up: totals and pass rate per framework."""
    return results.groupBy("framework").agg(
        F.count(F.lit(1)).cast("bigint").alias("runs"),
        F.count(F.when(F.col("success"), 1)).cast("bigint").alias("successes"),
        F.sum("total_tests").cast("bigint").alias("total_tests"),
        F.sum("passed").cast("bigint").alias("passed"),
        F.sum("failed").cast("bigint").alias("failed")).withColumn(
        "pass_rate", F.try_divide(F.col("passed").cast("double"), F.col("total_tests").cast("double")))


def detect_framework(project_files: DataFrame, markers: DataFrame) -> DataFrame:
    """Per project the first framework by priority whose marker exists
    (a marker ending in ``/`` is a top-level directory); none -> null.
    Each path is matched as itself and as its top-level directory against
    the broadcast marker table (equi joins only)."""
    top = F.nullif(F.regexp_extract("path", r"^([^/]+/)", 1), F.lit(""))
    cand = project_files.select("project_id", F.explode(F.array(F.col("path"), top)).alias("key"))
    j = cand.join(markers, cand["key"] == markers["marker"], "left")
    g = j.groupBy("project_id").agg(
        F.min(F.when(F.col("priority").isNotNull(), F.struct("priority", "framework"))).alias("m"))
    return g.select("project_id", F.col("m.framework").alias("framework"))


def _strip(c):
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def changed_files(status: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Porcelain text -> one row per file (text after the first blank
    run of the stripped line); blank lines and one-token lines skipped."""
    lines = status.select("run_id", F.explode(F.split(F.col(raw_col), "\n")).alias("line"))
    t = lines.select("run_id", _strip(F.col("line")).alias("l"))
    f = t.select("run_id", F.regexp_extract("l", r"^\S+\s+(.*)$", 1).alias("file"))
    return f.filter(F.col("file") != "")


def changed_file_counts(status: DataFrame, raw_col: str = "raw") -> DataFrame:
    """C7 roll-up: changed files per run (all, and distinct)."""
    return changed_files(status, raw_col).groupBy("run_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("files_changed"),
        F.countDistinct("file").cast("bigint").alias("distinct_files"))


DIFF_STAT = r"(\d+) insertions?.*?(\d+) deletions?"


def diff_totals(diffs: DataFrame, col: str = "diff_output", require_both: bool = True) -> DataFrame:
    """Lines added / removed from ``git diff --stat``; by default both
    counts must be present, else (0, 0) (quirk Q5).  ``require_both=False``
    reads insertions and deletions independently."""
    def num(c):
        return F.coalesce(F.nullif(c, F.lit("")).cast("bigint"), F.lit(0))
    if require_both:
        a = num(F.regexp_extract(col, DIFF_STAT, 1))
        r = num(F.regexp_extract(col, DIFF_STAT, 2))
    else:
        a = num(F.regexp_extract(col, r"(\d+) insertions?", 1))
        r = num(F.regexp_extract(col, r"(\d+) deletions?", 1))
    return diffs.select("run_id", a.alias("a"), r.alias("r")).groupBy("run_id").agg(
        F.sum("a").cast("bigint").alias("lines_added"),
        F.sum("r").cast("bigint").alias("lines_removed"),
        F.count(F.lit(1)).cast("bigint").alias("diffs"))

"""Run event logs (A4) and command invocation logs (A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import COMMAND_INVOCATION

EVENT_LINE = r"^\[(\d{2}:\d{2}:\d{2})\]\s+(\w+)(?::\s*(.*))?$"


def parse_run_events(lines: DataFrame, col: str = "value") -> DataFrame:
    """Split ``[HH:MM:SS] Kind: detail (label)`` lines; tokens, cost, pass
    counts and label out of the detail.  Lines that do not match keep
    ``kind`` null (never dropped)."""
    line = F.col(col)
    t = F.nullif(F.regexp_extract(line, EVENT_LINE, 1), F.lit(""))
    detail = F.nullif(F.regexp_extract(line, EVENT_LINE, 3), F.lit(""))
    tokens = F.nullif(F.regexp_replace(F.regexp_extract(detail, r"([0-9][0-9,]*) tokens", 1), ",", ""),
                      F.lit("")).cast("bigint")
    cost = F.nullif(F.regexp_extract(detail, r"\$([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")) \
        .cast("decimal(18,9)")
    passed = F.nullif(F.regexp_extract(detail, r"(\d+)/(\d+) tests? passing", 1), F.lit("")).cast("int")
    total = F.nullif(F.regexp_extract(detail, r"(\d+)/(\d+) tests? passing", 2), F.lit("")).cast("int")
    label = F.nullif(F.regexp_extract(detail, r"\(([^)]*)\)\s*$", 1), F.lit(""))
    secs = (F.split(t, ":").getItem(0).cast("int") * 3600 + F.split(t, ":").getItem(1).cast("int") * 60
            + F.split(t, ":").getItem(2).cast("int"))
    keep = [c for c in lines.columns if c != col]
    return lines.select(*keep, line.alias("line"), t.alias("time_of_day"), secs.alias("second_of_day"),
                        F.nullif(F.regexp_extract(line, EVENT_LINE, 2), F.lit("")).alias("kind"),
                        detail.alias("detail"), tokens.alias("tokens"), cost.alias("cost"),
                        passed.alias("tests_passing"), total.alias("tests_total"), label.alias("label"))


def read_run_events(spark: SparkSession, path: str) -> DataFrame:
    """A4: run event text files -> event rows (file path kept as source)."""
    lines = spark.read.text(path).withColumn("source_file", F.col("_metadata.file_path"))
    return parse_run_events(lines)


def read_invocations(spark: SparkSession, path: str) -> DataFrame:
    """A5: command invocation + result JSON lines with nested token usage,
    flattened to typed columns."""
    df = spark.read.schema(COMMAND_INVOCATION).json(path)
    return df.select("command", "args", "cwd", F.col("sessionId").alias("session_id"),
                     F.col("extraContext").alias("extra_context"), "success", "output",
                     F.col("filesChanged").alias("files_changed"), "error",
                     F.col("durationMs").alias("duration_ms"),
                     F.col("tokenUsage.input").alias("input_tokens"),
                     F.col("tokenUsage.output").alias("output_tokens"), "ts")

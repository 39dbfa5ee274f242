"""Token, cost, estimate and settings operators (B1-B5), plus command
search / outcome / link extraction (B7-B9).  Column expressions only; the
dimension look-ups are broadcast left joins with a default."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PR_LINK, estimate_tokens, loose_success, strict_success  # noqa: F401
from ..schemas import COMPLEXITY, DEFAULT_COMPLEXITY, DEFAULT_ENVIRONMENT, ENV_PRESETS, default_rate

TOTAL = "DECIMAL(38,9)"


def _text(prompt, output):
    return F.concat(F.coalesce(prompt, F.lit("")), F.coalesce(output, F.lit("")))


def token_accounting(executions: DataFrame, dialect: str = "floor") -> DataFrame:
    """B1: tokens of every execution from prompt + output; per-run totals."""
    t = _text(F.col("prompt"), F.col("output"))
    e = executions.select("run_id", F.length(t).cast("bigint").alias("chars"),
                          estimate_tokens(t, dialect).alias("tokens"))
    return e.groupBy("run_id").agg(F.count(F.lit(1)).cast("bigint").alias("executions"),
                                   F.sum("chars").cast("bigint").alias("chars"),
                                   F.sum("tokens").cast("bigint").alias("tokens"))


def cost_accounting(df: DataFrame, pricing: DataFrame) -> DataFrame:
    """B2: cost = tokens x (input + output) / 2 per token of the row's model;
    an unknown model falls back to the default model's price.  Per run and
    model, exact DECIMAL."""
    j = df.join(pricing, "model", "left")
    rate = F.coalesce(F.col("rate_per_token"), F.lit(default_rate()).cast("decimal(12,9)"))
    j = j.withColumn("priced_cost", (F.col("tokens_used") * rate).cast(TOTAL))
    return j.groupBy("run_id", "model").agg(
        F.sum("tokens_used").cast("bigint").alias("tokens"),
        F.sum("priced_cost").cast(TOTAL).alias("cost"),
        F.bool_or(F.col("rate_per_token").isNull()).alias("default_price"))


def budget_estimate(plan: DataFrame, complexity: DataFrame) -> DataFrame:
    """Prompt tokens x (1 + multiplier) priced at the default model;
    an unknown complexity uses ``medium``."""
    c = complexity.withColumnRenamed("name", "complexity")
    j = plan.join(c, "complexity", "left")
    default_mult = F.lit(dict(COMPLEXITY)[DEFAULT_COMPLEXITY])
    mult = F.coalesce(F.col("multiplier"), default_mult)
    pt = estimate_tokens(F.col("prompt"))
    total = (pt * (F.lit(1) + mult)).cast("bigint")
    return j.select("run_id", "seq", "complexity", pt.alias("prompt_tokens"),
                    total.alias("tokens_estimate"),
                    (total * F.lit(default_rate()).cast("decimal(12,9)")).cast(TOTAL)
                    .alias("estimated_cost"))


def plan_complexity(plan: DataFrame) -> DataFrame:
    """A stage plan (J1) with the complexity that its budget (B3) is estimated
    by: ``high`` on the critical path, else ``medium``."""
    return plan.withColumn("complexity", F.when(F.col("critical_path"), F.lit("high")).otherwise(F.lit("medium")))


_DIGITS = "[0-9](?:_?[0-9])*"
_INT = rf"^\s*[+-]?{_DIGITS}\s*$"
_FLOAT = (rf"(?i)^\s*[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
          r"|inf|infinity|nan)\s*$")


def _number(c, pattern: str, kind: str):
    """The number that Python's int() or float() reads, else null: single
    underscores between digits are fine, type suffixes are not."""
    return F.when(c.rlike(pattern), F.trim(F.replace(c, F.lit("_"), F.lit(""))).try_cast(kind))


def effective_settings(overrides: DataFrame, presets: DataFrame) -> DataFrame:
    """Preset by environment (unknown -> development); each value is
    replaced by its override when that parses, else the preset is kept."""
    env = F.when(F.col("environment").isin([p[0] for p in ENV_PRESETS]), F.col("environment")).otherwise(F.lit(DEFAULT_ENVIRONMENT))
    o = overrides.withColumn("preset", env)
    j = o.join(presets, "preset", "left")
    mt = _number(F.col("max_tokens"), _INT, "bigint")
    temp = _number(F.col("temperature"), _FLOAT, "double")
    to = _number(F.col("timeout"), _INT, "int")
    return j.select(
        "run_id", "environment", "preset",
        F.coalesce(mt, F.col("preset_max_tokens")).alias("max_tokens"),
        F.coalesce(temp, F.col("preset_temperature")).alias("temperature"),
        F.coalesce(to, F.col("preset_timeout_s")).alias("timeout_s"),
        (mt.isNotNull() | temp.isNotNull() | to.isNotNull()).alias("overridden"))


def decode_run_ids(df: DataFrame, prefixes: DataFrame, id_col: str = "workflow_id") -> DataFrame:
    """``<prefix>-<epoch ms>`` -> prefix, workflow type (null for an
    unknown prefix or an id of another form), start day; runs per type and day."""
    d = df.select(
        F.nullif(F.regexp_extract(id_col, r"^(.+)-([0-9]+)$", 1), F.lit("")).alias("prefix"),
        F.regexp_extract(id_col, r"^(.+)-([0-9]+)$", 2).try_cast("bigint").alias("started_ms"))
    d = d.join(prefixes, "prefix", "left")
    day = F.date_from_unix_date(F.floor(F.col("started_ms") / F.lit(86400000)).cast("int"))
    return d.groupBy("workflow_type", "prefix", day.alias("start_day")).agg(
        F.count(F.lit(1)).cast("bigint").alias("runs"))


def search_invocations(df: DataFrame, prefix: str | None = None, min_ms: int | None = None,
                       max_ms: int | None = None, failure_like: str | None = None) -> DataFrame:
    """Filter by command prefix, duration range and failure text."""
    cond = F.lit(True)
    if prefix is not None:
        cond = cond & F.col("command").startswith(prefix)
    if min_ms is not None:
        cond = cond & (F.col("duration_ms") >= min_ms)
    if max_ms is not None:
        cond = cond & (F.col("duration_ms") <= max_ms)
    if failure_like is not None:
        cond = cond & F.col("output").contains(failure_like)
    return df.filter(cond)


def command_outcomes(df: DataFrame) -> DataFrame:
    """Success under the strict and the loose rule per command, and how
    often the two disagree."""
    s = strict_success(F.col("exit_code"), F.col("output"))
    lo = loose_success(F.col("exit_code"), F.col("output"))
    return df.groupBy("command").agg(
        F.count(F.lit(1)).cast("bigint").alias("invocations"),
        F.count(F.when(s, 1)).cast("bigint").alias("strict_ok"),
        F.count(F.when(lo, 1)).cast("bigint").alias("loose_ok"),
        F.count(F.when(s != lo, 1)).cast("bigint").alias("disagree"))


def rule_disagreements(df: DataFrame) -> DataFrame:
    """The invocations on which the strict and the loose rule disagree
    (e.g. "finished with 0 errors": strict success, loose failure)."""
    s = strict_success(F.col("exit_code"), F.col("output"))
    lo = loose_success(F.col("exit_code"), F.col("output"))
    return df.filter(s != lo).select("event_id", "session_id", "command", "exit_code", "output",
                                     s.alias("strict_ok"), lo.alias("loose_ok"))


def extract_pr_links(df: DataFrame, key: str = "session_id") -> DataFrame:
    """First pull-request link of each output (greedy within a line);
    distinct links per session with counts."""
    link = F.nullif(F.regexp_extract("output", PR_LINK, 0), F.lit(""))
    return (df.select(key, link.alias("pr_link")).filter(F.col("pr_link").isNotNull())
            .groupBy(key, "pr_link").agg(F.count(F.lit(1)).cast("bigint").alias("mentions")))

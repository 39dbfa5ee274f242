"""Stage plan expansion (J1): runs x stage templates of the run's workflow
type, minus skipped stages, with custom prompts and the project path filled
in.  Templates are a fixed dimension (broadcast); skips are a left anti join
and overrides a left join on (run_id, stage)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import DEFAULT_WORKFLOW_TYPE, STAGE_TEMPLATES, TEMPLATE_MAX_TOKENS, TEMPLATE_TEMPERATURE

KNOWN_TYPES = sorted({t[0] for t in STAGE_TEMPLATES})


def stage_plan(runs: DataFrame, templates: DataFrame, skips: DataFrame | None = None,
               overrides: DataFrame | None = None) -> DataFrame:
    """``runs``: run_id, workflow_type, project_path; ``skips``: run_id,
    stage; ``overrides``: run_id, stage, prompt."""
    wt = F.when(F.col("workflow_type").isin(KNOWN_TYPES), F.col("workflow_type")) \
        .otherwise(F.lit(DEFAULT_WORKFLOW_TYPE))
    r = runs.select("run_id", wt.alias("workflow_type"), "project_path")
    p = r.join(templates, "workflow_type").withColumnRenamed("name", "stage")
    if skips is not None:
        p = p.join(skips.select("run_id", "stage"), ["run_id", "stage"], "left_anti")
    if overrides is not None:
        o = overrides.select("run_id", "stage", F.col("prompt").alias("_custom"))
        p = p.join(o, ["run_id", "stage"], "left")
        tmpl = F.coalesce(F.col("_custom"), F.col("prompt_template"))
    else:
        tmpl = F.col("prompt_template")
    prompt = F.replace(tmpl, F.lit("{project_path}"), F.col("project_path"))
    return p.select("run_id", "workflow_type", "ord", "stage", prompt.alias("prompt"),
                    "requires_approval", "critical_path", "skip_tests",
                    F.lit(TEMPLATE_MAX_TOKENS).alias("max_tokens"),
                    F.lit(TEMPLATE_TEMPERATURE).alias("temperature"))

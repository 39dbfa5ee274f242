"""Text rules as Column expressions: token estimate, success rules, link
pattern, branch names, failure masking and classes, file previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CHARS_PER_TOKEN, FILE_PREVIEW_N


def estimate_tokens(text, dialect: str = "floor"):
    """Tokens = len(text) / 4 (code points), floored (default) or, in the
    example dialect, rounded up."""
    n = F.length(text) / F.lit(CHARS_PER_TOKEN)
    return (F.ceil(n) if dialect == "ceil" else F.floor(n)).cast("bigint")

def strict_success(exit_code, output):
    return (exit_code == 0) & ~output.contains("ERROR")


def loose_success(exit_code, output):
    return (exit_code == 0) & ~F.lower(output).contains("error")

PR_LINK = r"https://github\.com/.*/pull/\d+"

# Failure classes by the text of the recorded error messages.
FAILURE_CLASSES = [
    ("approval_timeout", "Approval timeout for stage"),
    ("rejected", "rejected by developer"),
    ("critical_tests", "failed tests"),
    ("final_suite", "Final test suite failed"),
    ("iterations_exhausted", "Failed to fix issue after"),
    ("execution_timeout", "execution timed out"),
    ("execution_failed", "execution failed"),
]


def failure_class(err) -> Column:
    expr = None
    for cls, needle in FAILURE_CLASSES:
        cond = F.instr(err, needle) > 0
        expr = F.when(cond, F.lit(cls)) if expr is None else expr.when(cond, F.lit(cls))
    return expr.otherwise(F.lit("other"))


def mask_error(err, stage_names) -> Column:
    """Mask quoted text, stage names and numbers so equal failures group."""
    stages = "|".join(s.replace("-", "\\-") for s in sorted(stage_names, key=len, reverse=True))
    m = F.regexp_replace(err, "'[^']*'", "<q>")
    m = F.regexp_replace(m, f"\\b({stages}|iteration-[0-9]+|feature-[^ ]+)\\b", "<stage>")
    return F.regexp_replace(m, "[0-9]+", "<n>")

def branch_name(idx, feature, dialect: str = "python"):
    """``feature-<i>-<name>``: every blank to ``-`` and lower case (default),
    or runs of whitespace to ``-`` with case kept (``collapse``)."""
    if dialect == "collapse":
        name = F.regexp_replace(feature, r"\s+", "-")
    else:
        name = F.lower(F.replace(feature, F.lit(" "), F.lit("-")))
    return F.concat(F.lit("feature-"), idx.cast("string"), F.lit("-"), name)

def preview_text(preview: Column, count: Column, n: int = FILE_PREVIEW_N, indent: str = "") -> Column:
    """``- name`` lines of up to ``n`` names, then ``... and N more`` for those
    of ``count`` that are not shown."""
    preview = F.slice(preview, 1, n)
    shown = F.size(preview)
    lines = F.array_join(F.transform(preview, lambda x: F.concat(F.lit(indent + "- "), x)), "\n")
    more = F.when(count > shown, F.concat(F.lit("\n" + indent + "... and "), (count - shown).cast("string"),
                                       F.lit(" more"))).otherwise(F.lit(""))
    return F.concat(lines, more)

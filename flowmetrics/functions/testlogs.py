"""Test-log dialects as Column functions ``fn(output, return_code) ->
struct<success, total_tests, passed, failed, errors, coverage>`` and their
registry (the test-runner extension point, U1).  Regex and JSON parsing only,
inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NPM_SCHEMA = ("success boolean, numTotalTests int, numPassedTests int, numFailedTests int, "
              "coverageMap struct<total:struct<lines:struct<pct:string>>>, _corrupt_record string")

NO_FRAMEWORK = "No supported test framework detected"


def _result(success, total, passed, failed, errors, coverage=None) -> Column:
    return F.struct(success.alias("success"), total.cast("int").alias("total_tests"),
                    passed.cast("int").alias("passed"), failed.cast("int").alias("failed"),
                    errors.alias("errors"),
                    (coverage if coverage is not None else F.lit(None)).cast("double")
                    .alias("coverage"))


def _errors_if_failed(success, output):
    return F.when(success, F.array().cast("array<string>")).otherwise(F.array(output))


def npm_json(output: Column) -> Column:
    return F.from_json(output, NPM_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"})


def npm_coverage(parsed: Column) -> Column:
    """Line coverage of a parsed report; null where it is no number."""
    return parsed.getField("coverageMap").getField("total").getField("lines").getField("pct").try_cast("double")


def parse_npm(output: Column, rc: Column, parsed: Column | None = None) -> Column:
    """JSON report (success defaults to rc == 0, counts to 0, coverage at
    coverageMap.total.lines.pct); non-JSON text: 0 tests, 1 passed or failed
    by the return code, the output as error on failure.  ``parsed``: the
    output already parsed by :func:`npm_json` (parse once, read many)."""
    j = parsed if parsed is not None else npm_json(output)
    # empty text parses to a null struct and is no report
    is_json = j.isNotNull() & j.getField("_corrupt_record").isNull()
    ok_rc = rc == 0
    js = _result(F.coalesce(j.getField("success"), ok_rc),
                 F.coalesce(j.getField("numTotalTests"), F.lit(0)),
                 F.coalesce(j.getField("numPassedTests"), F.lit(0)),
                 F.coalesce(j.getField("numFailedTests"), F.lit(0)),
                 F.array().cast("array<string>"),
                 npm_coverage(j))
    txt = _result(ok_rc, F.lit(0), F.when(ok_rc, 1).otherwise(0), F.when(ok_rc, 0).otherwise(1),
                  _errors_if_failed(ok_rc, F.coalesce(output, F.lit(""))))
    return F.when(is_json, js).otherwise(txt)


def _first_int(output, pattern):
    return F.coalesce(F.nullif(F.regexp_extract(output, pattern, 1), F.lit("")).cast("int"),
                      F.lit(0))


def parse_pytest(output: Column, rc: Column) -> Column:
    """First ``N passed`` / ``N failed`` / ``N error``; errors count as
    failures; success by return code."""
    p = _first_int(output, r"(\d+) passed")
    f = _first_int(output, r"(\d+) failed")
    e = _first_int(output, r"(\d+) error")
    ok = rc == 0
    return _result(ok, p + f + e, p, f + e, _errors_if_failed(ok, output))


def _count_result(output, rc, ok_pat, fail_pat):
    p = F.regexp_count(output, F.lit(ok_pat))
    f = F.regexp_count(output, F.lit(fail_pat))
    ok = rc == 0
    return _result(ok, p + f, p, f, _errors_if_failed(ok, output))


def parse_cargo(output: Column, rc: Column) -> Column:
    """Count ``test .. ... ok`` / ``... FAILED`` lines (text, quirk Q10)."""
    return _count_result(output, rc, r"test .+ \.\.\. ok", r"test .+ \.\.\. FAILED")


def parse_go(output: Column, rc: Column) -> Column:
    """C4: count ``--- PASS:`` / ``--- FAIL:`` (subtests included)."""
    return _count_result(output, rc, r"--- PASS:", r"--- FAIL:")


DIALECTS: dict[str, Callable[[Column, Column], Column]] = {
    "npm": parse_npm, "pytest": parse_pytest, "cargo": parse_cargo, "go": parse_go,
}


def _npm_line_coverage(output: Column, rc: Column) -> Column:
    j = npm_json(output)
    return F.when(j.getField("_corrupt_record").isNull(), npm_coverage(j))


def _no_coverage(output: Column, rc: Column) -> Column:
    return F.lit(None).cast("double")


#: the coverage of a dialect's logs alone, without its counts
COVERAGE: dict[Callable, Callable[[Column, Column], Column]] = {
    parse_npm: _npm_line_coverage, parse_pytest: _no_coverage, parse_cargo: _no_coverage, parse_go: _no_coverage,
}


def coverage_of(parser: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """A dialect's coverage column; of one that gives none apart, the field of its result."""
    return COVERAGE.get(parser, lambda output, rc: parser(output, rc).getField("coverage"))


def register_dialect(name: str, fn: Callable[[Column, Column], Column],
                     coverage: Callable[[Column, Column], Column] | None = None) -> None:
    """Add a test-log dialect (a Column function returning the result struct);
    ``coverage``: its coverage alone, where that is cheaper."""
    DIALECTS[name.lower()] = fn
    if coverage is not None:
        COVERAGE[fn] = coverage


RESULT = ("struct<success: boolean, total_tests: int, passed: int, failed: int, errors: array<string>, "
          "coverage: double>")


def vectorised(parse: Callable[[pa.Array, pa.Array], dict[str, pa.Array]]) -> Callable[[Column, Column], Column]:
    """A dialect from a function over Arrow arrays, which takes the outputs and
    return codes of a batch and gives the result's fields (those not given are
    null).  Python sees whole batches, never single rows; logs of other dialects
    come as null and their results are not used."""
    fields = ("success", "total_tests", "passed", "failed", "errors", "coverage")
    types = (pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.float64())

    def batch(output: pa.Array, rc: pa.Array) -> pa.Array:
        got = parse(output, rc)
        return pa.StructArray.from_arrays(
            [got[f].cast(t) if f in got else pa.nulls(len(output), t) for f, t in zip(fields, types)], list(fields))

    def fn(output: Column, rc: Column) -> Column:
        return F.arrow_udf(batch, RESULT)(output, rc)

    fn.vectorised = True
    return fn

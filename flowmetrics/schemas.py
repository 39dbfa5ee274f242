"""Domain schemas and the small, fixed dimension tables.

Dimension rows are fixed values that results must agree with; they are kept
here as plain data, in their natural order.  Each is offered both as a Spark
DataFrame (always small, so safe to broadcast) and as a SQL ``VALUES`` text
for the DuckDB oracle.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 9)
MONEY_SQL = "DECIMAL(18,9)"
TOTAL_SQL = "DECIMAL(38,9)"

# ---------------------------------------------------------------------------
# Fixed values (must equal the recorded behaviour)
# ---------------------------------------------------------------------------
CHARS_PER_TOKEN = 4
COOLDOWN_TOKEN_LIMIT = 50000
COOLDOWN_SECONDS = 30
APPROVAL_TIMEOUT_S = 3600
RETRY_INITIAL_S = 2
RETRY_COEFFICIENT = 2
RETRY_MAX_ATTEMPTS = 3
RETRY_MAX_INTERVAL_S = 60
MAX_ITERATIONS = 5
ITERATION_BACKOFF_BASE_S = 5
ITERATION_BACKOFF_MAX_S = 30
AGENT_MAX_STEPS = 15
FILE_PREVIEW_N = 10
DEFAULT_MODEL = "claude-sonnet-4-5"

# model, input price per 1K tokens, output price per 1K tokens
MODEL_PRICING = [
    ("claude-sonnet-4-5", "0.003", "0.015"),
    ("claude-opus-4", "0.015", "0.075"),
]

# complexity name, completion multiplier (unknown -> medium)
COMPLEXITY = [("low", 2), ("medium", 4), ("high", 8)]
DEFAULT_COMPLEXITY = "medium"

# environment, max_tokens, temperature, timeout_s (unknown -> development)
ENV_PRESETS = [
    ("production", 8000, "0.2", 600),
    ("staging", 8000, "0.3", 600),
    ("development", 100000, "0.3", 1800),
]
DEFAULT_ENVIRONMENT = "development"

# activity kind, start-to-close limit in seconds
ACTIVITY_TIMEOUTS = [
    ("estimate", 60), ("snapshot", 120), ("execute", 600), ("tests", 600),
    ("restore", 120), ("notify", 60), ("metrics", 60), ("branch", 120),
    ("feature execute", 900),
]

# workflow-id prefix, workflow type
RUN_ID_PREFIXES = [
    ("llm-wrapper-dev", "develop"),
    ("iterative-fix", "iterative"),
    ("parallel-dev", "parallel"),
]

# category, command
COMMAND_CATALOG = [
    ("documentation", "api-docs"), ("documentation", "update-readme"),
    ("documentation", "architecture-review"),
    ("development", "code-review"), ("development", "debug-session"),
    ("development", "refactor-analysis"),
    ("project", "create-feature"), ("project", "scaffold-component"),
    ("project", "setup-environment"),
    ("testing", "generate-tests"), ("testing", "integration-tests"),
    ("testing", "coverage-analysis"),
    ("deployment", "prepare-release"), ("deployment", "rollback-procedure"),
    ("deployment", "deploy-staging"),
    ("custom", "domain-activator"),
]

# priority, framework, marker path (a trailing "/" marks a directory)
FRAMEWORK_MARKERS = [
    (1, "npm", "package.json"),
    (2, "pytest", "pytest.ini"), (2, "pytest", "pyproject.toml"),
    (2, "pytest", "setup.py"), (2, "pytest", "tests/"),
    (3, "cargo", "Cargo.toml"),
    (4, "go", "go.mod"),
]

NOTIFICATION_CHANNELS = ["console", "logging", "slack", "webhook"]

# ---------------------------------------------------------------------------
# Domain schemas
# ---------------------------------------------------------------------------
METRICS_RECORD = T.StructType([
    T.StructField("stage", T.StringType()),
    T.StructField("tokens_used", T.LongType()),
    T.StructField("cost", MONEY),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("files_modified", T.IntegerType()),
    T.StructField("lines_added", T.LongType()),
    T.StructField("lines_removed", T.LongType()),
    T.StructField("tests_pass", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
])

STAGE_METRICS = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("stage", T.StringType()),
    T.StructField("tokens_used", T.LongType()),
    T.StructField("cost", MONEY),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("files_modified", T.IntegerType()),
    T.StructField("lines_added", T.LongType()),
    T.StructField("lines_removed", T.LongType()),
    T.StructField("tests_pass", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
])

TEST_RESULT = T.StructType([
    T.StructField("success", T.BooleanType()),
    T.StructField("total_tests", T.IntegerType()),
    T.StructField("passed", T.IntegerType()),
    T.StructField("failed", T.IntegerType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("errors", T.ArrayType(T.StringType())),
    T.StructField("coverage", T.DoubleType()),
])

COMMAND_INVOCATION = T.StructType([
    T.StructField("command", T.StringType()),
    T.StructField("args", T.ArrayType(T.StringType())),
    T.StructField("cwd", T.StringType()),
    T.StructField("sessionId", T.StringType()),
    T.StructField("extraContext", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("output", T.StringType()),
    T.StructField("filesChanged", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
    T.StructField("durationMs", T.LongType()),
    T.StructField("tokenUsage", T.StructType([
        T.StructField("input", T.LongType()),
        T.StructField("output", T.LongType()),
    ])),
    T.StructField("ts", T.TimestampNTZType()),
])


# ---------------------------------------------------------------------------
# Dimensions as DataFrames / SQL
# ---------------------------------------------------------------------------
def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, Decimal)):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def values_sql(rows, columns, casts=None) -> str:
    """``(SELECT ... FROM (VALUES ...) t(cols))`` text for a dimension."""
    casts = casts or {}
    body = ", ".join("(" + ", ".join(_sql_lit(v) for v in r) + ")" for r in rows)
    sel = ", ".join(f"CAST({c} AS {casts[c]}) AS {c}" if c in casts else c for c in columns)
    return f"(SELECT {sel} FROM (VALUES {body}) AS t({', '.join(columns)}))"


def pricing_rows():
    """(model, rate per token) with rate = (input + output) / 2 / 1000."""
    return [(m, (Decimal(i) + Decimal(o)) / 2 / 1000) for m, i, o in MODEL_PRICING]


def pricing_df(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(
        [(m, r) for m, r in pricing_rows()],
        T.StructType([T.StructField("model", T.StringType()),
                      T.StructField("rate_per_token", T.DecimalType(12, 9))]))
    return F.broadcast(df)


def pricing_sql() -> str:
    return values_sql([(m, r) for m, r in pricing_rows()], ["model", "rate_per_token"],
                      {"rate_per_token": "DECIMAL(12,9)"})


def default_rate() -> Decimal:
    return dict(pricing_rows())[DEFAULT_MODEL]


def complexity_df(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(COMPLEXITY, "name string, multiplier int"))


def complexity_sql() -> str:
    return values_sql(COMPLEXITY, ["name", "multiplier"], {"multiplier": "INTEGER"})


def env_presets_df(spark: SparkSession) -> DataFrame:
    rows = [(e, m, float(t), s) for e, m, t, s in ENV_PRESETS]
    return F.broadcast(spark.createDataFrame(
        rows, "preset string, preset_max_tokens bigint, preset_temperature double, preset_timeout_s int"))


def env_presets_sql() -> str:
    return values_sql(ENV_PRESETS, ["preset", "preset_max_tokens", "preset_temperature",
                                    "preset_timeout_s"],
                      {"preset_max_tokens": "BIGINT", "preset_temperature": "DOUBLE",
                       "preset_timeout_s": "INTEGER"})


def activity_timeouts_df(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(ACTIVITY_TIMEOUTS, "activity string, limit_s int"))


def activity_timeouts_sql() -> str:
    return values_sql(ACTIVITY_TIMEOUTS, ["activity", "limit_s"], {"limit_s": "INTEGER"})


def command_catalog_df(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(COMMAND_CATALOG, "category string, name string"))


def command_catalog_sql() -> str:
    return values_sql(COMMAND_CATALOG, ["category", "name"])


def framework_markers_df(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(FRAMEWORK_MARKERS,
                                             "priority int, framework string, marker string"))


def framework_markers_sql() -> str:
    return values_sql(FRAMEWORK_MARKERS, ["priority", "framework", "marker"],
                      {"priority": "INTEGER"})


def run_id_prefixes_df(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(RUN_ID_PREFIXES, "prefix string, workflow_type string"))


def run_id_prefixes_sql() -> str:
    return values_sql(RUN_ID_PREFIXES, ["prefix", "workflow_type"])


# ---------------------------------------------------------------------------
# Stage templates (fixed values): workflow type, order, name, prompt template,
# requires_approval, critical_path, skip_tests; max_tokens 8000 and
# temperature 0.3 for all.  Unknown workflow types use "llm-wrapper".
# ---------------------------------------------------------------------------
DEFAULT_WORKFLOW_TYPE = "llm-wrapper"
STAGE_TEMPLATES = [
    ("llm-wrapper", 1, "scaffold",
     "Create a TypeScript LLM wrapper library with:\n- Support for OpenAI, Anthropic, and local models\n"
     "- Type-safe interfaces\n- Streaming support\n- Error handling and retries\n- Cost tracking\n"
     "Setup project structure in {project_path}", False, True, False),
    ("llm-wrapper", 2, "core-implementation",
     "Implement core wrapper functionality:\n- Base LLMClient abstract class\n"
     "- OpenAI provider implementation\n- Anthropic provider implementation\n"
     "- Unified response format\n- Token counting utilities", True, True, False),
    ("llm-wrapper", 3, "streaming",
     "Add streaming support:\n- Server-sent events handling\n- Async iterators for streams\n"
     "- Backpressure handling\n- Stream cancellation", False, True, False),
    ("llm-wrapper", 4, "error-handling",
     "Implement robust error handling:\n- Custom error classes for different failure types\n"
     "- Exponential backoff with jitter\n- Circuit breaker pattern\n- Request timeout handling\n"
     "- Rate limit detection and retry", False, False, False),
    ("llm-wrapper", 5, "testing",
     "Create comprehensive test suite:\n- Unit tests for each provider\n"
     "- Integration tests with mock APIs\n- Streaming tests\n- Error handling tests\n"
     "- Edge case coverage", False, True, False),
    ("llm-wrapper", 6, "documentation",
     "Generate complete documentation:\n- README with quick start guide\n"
     "- API reference for all public methods\n- Usage examples for common scenarios\n"
     "- Migration guides\n- TypeScript type documentation", False, False, True),
    ("api", 1, "scaffold",
     "Create API project structure in {project_path}:\n- FastAPI/Express framework setup\n"
     "- Database models and migrations\n- Authentication middleware\n- API documentation setup",
     False, True, False),
    ("api", 2, "endpoints",
     "Implement API endpoints:\n- CRUD operations for main resources\n- Input validation\n"
     "- Error responses\n- Pagination support", True, True, False),
    ("api", 3, "authentication",
     "Add authentication and authorization:\n- JWT token handling\n- Role-based access control\n"
     "- API key management\n- Rate limiting", True, True, False),
    ("api", 4, "testing",
     "Create API test suite:\n- Unit tests for handlers\n- Integration tests for endpoints\n"
     "- Authentication tests\n- Error handling tests", False, True, False),
    ("frontend", 1, "scaffold",
     "Create frontend project in {project_path}:\n- React/Vue/Svelte setup\n"
     "- Component library integration\n- State management setup\n- Build configuration",
     False, True, False),
    ("frontend", 2, "components",
     "Implement UI components:\n- Layout components\n- Form components\n"
     "- Data display components\n- Navigation components", False, True, False),
    ("frontend", 3, "pages",
     "Create application pages:\n- Main dashboard\n- Detail views\n- Forms and editors\n"
     "- Settings pages", True, True, False),
    ("frontend", 4, "testing",
     "Add frontend tests:\n- Component unit tests\n- Integration tests\n- Accessibility tests\n"
     "- Visual regression tests", False, True, False),
]
TEMPLATE_MAX_TOKENS = 8000
TEMPLATE_TEMPERATURE = 0.3


def stage_ordinals(workflow_type: str = DEFAULT_WORKFLOW_TYPE) -> dict[str, int]:
    return {name: o for wt, o, name, *_ in STAGE_TEMPLATES if wt == workflow_type}


def skip_test_stages() -> list[str]:
    return sorted({name for _, _, name, _, _, _, skip in STAGE_TEMPLATES if skip})


def known_stage_names() -> list[str]:
    seen: list[str] = []
    for _, _, name, *_ in STAGE_TEMPLATES:
        if name not in seen:
            seen.append(name)
    return seen


def templates_df(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(
        STAGE_TEMPLATES,
        "workflow_type string, ord int, name string, prompt_template string, "
        "requires_approval boolean, critical_path boolean, skip_tests boolean"))


def templates_sql() -> str:
    return values_sql(STAGE_TEMPLATES, ["workflow_type", "ord", "name", "prompt_template",
                                        "requires_approval", "critical_path", "skip_tests"],
                      {"ord": "INTEGER"})

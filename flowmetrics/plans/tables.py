"""Spark side of the bindings.

``Bindings(spark, sf_dir)`` reads the given parquet tables and exposes each
binding as a DataFrame.  Bindings without a per-key window run the shared SQL
text unchanged (over uniquely named temp views).  Bindings that number rows
per key (``row_number``/``lead``) are built with the skew-safe
:func:`flowmetrics.plans.scan.row_number_scan` or an equi self-join, with the
same column expressions, so that a hot key never becomes one task.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binding_sql import BINDING_SQL
from .scan import row_number_scan

SOURCE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def oracle_binding(name: str) -> str:
    """Binding text for the DuckDB oracle (a CTE body)."""
    return BINDING_SQL[name].strip()


def with_bindings(names, body: str) -> str:
    """``WITH b1 AS (...), b2 AS (...) <body>`` for the oracle."""
    ctes = ",\n".join(f"{n} AS (\n{oracle_binding(n)}\n)" for n in names)
    if not ctes:
        return body
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {ctes},\n{body.lstrip()[5:]}"
    return f"WITH {ctes}\n{body}"


class Bindings:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._tag = hashlib.sha1(self.sf_dir.encode()).hexdigest()[:8]
        self._cache: dict[str, DataFrame] = {}

    # -- raw tables -------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str) -> str:
        view = f"fm_{name}_{self._tag}"
        self.table(name).createOrReplaceTempView(view)
        return view

    def _sql(self, binding: str) -> DataFrame:
        text = BINDING_SQL[binding]

        def repl(m: re.Match) -> str:
            return f"FROM {self._view(m.group(1))}"

        text = re.sub(r"\bFROM (" + "|".join(SOURCE_TABLES) + r")\b", repl, text)
        return self.spark.sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("b_"):
            if name not in self._cache:
                builder = getattr(type(self), "_build_" + name, None)
                self._cache[name] = builder(self) if builder else self._sql(name)
            return self._cache[name]
        raise AttributeError(name)

    # -- windowed bindings, skew-safe ---------------------------------------
    def _build_b_stage_metrics(self) -> DataFrame:
        ev = self.table("events")
        cols = ev.selectExpr(
            "user_id AS run_id", "event_id",
            """CASE event_type WHEN 'signup' THEN 'scaffold' WHEN 'view' THEN 'core-implementation'
                 WHEN 'click' THEN 'streaming' WHEN 'purchase' THEN 'testing'
                 ELSE 'error-handling' END AS stage""",
            "CAST(round(value * 100) AS BIGINT) AS tokens_used",
            """CAST(CAST(round(value * 100) AS BIGINT) * CAST(0.000009 AS DECIMAL(12,9))
                 AS DECIMAL(18,9)) AS cost""",
            "CAST((event_id % 600 + 1) * 1000 AS BIGINT) AS duration_ms",
            "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS files_modified",
            "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 3 AS lines_added",
            "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS lines_removed",
            "NOT (event_type = 'error' AND event_id % 2 = 0) AS tests_pass",
            """CASE WHEN event_type = 'error' AND event_id % 10 = 1
                      THEN 'Critical stage error-handling failed tests'
                    WHEN event_type = 'error' AND event_id % 10 = 5
                      THEN 'Approval timeout for stage core-implementation' END AS error""",
            "ts")
        out = row_number_scan(cols, ["run_id"], ["ts", "event_id"], "seq")
        return out.select("run_id", "seq", "event_id", "stage", "tokens_used", "cost",
                          "duration_ms", "files_modified", "lines_added", "lines_removed",
                          "tests_pass", "error", "ts")

    def _build_b_executions(self) -> DataFrame:
        # lead() over consecutive turns == equi self-join on (conv_id, turn + 1)
        conv = self.table("conversations")
        cur = conv.filter(F.col("role") == "user").select(
            F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"),
            F.col("text").alias("prompt"), (F.col("turn") + 1).alias("_next"))
        nxt = conv.filter(F.col("role") == "assistant").select(
            F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("text").alias("output"))
        j = cur.join(nxt, (cur["run_id"] == nxt["_c"]) & (cur["_next"] == nxt["_t"]), "inner")
        return j.select("run_id", "seq", "prompt", "output")

    def _build_b_feature_runs(self) -> DataFrame:
        o = self.table("orders").selectExpr(
            "o_custkey AS run_id", "o_orderkey",
            "concat('Add Feature ', CAST(o_orderkey % 97 AS STRING)) AS feature",
            "o_orderstatus <> 'F' AS success",
            "o_orderpriority = '5-LOW' AS raised",
            "CAST(round(o_totalprice) AS BIGINT) AS tokens_used",
            "CAST((o_orderkey % 600 + 1) * 1000 AS BIGINT) AS duration_ms")
        o = row_number_scan(o, ["run_id"], ["o_orderkey"], "idx")
        return o.select("run_id", "o_orderkey", (F.col("idx") - 1).cast("int").alias("idx"),
                        "feature", "success", "raised", "tokens_used", "duration_ms")

    def _build_b_iterations(self) -> DataFrame:
        li = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
            "l_shipdate", "l_returnflag", "l_linestatus", "l_quantity")
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
                 "l_returnflag", "l_linestatus"]
        li = row_number_scan(li, ["l_orderkey"], order, "iteration", "int")
        return li.selectExpr("l_orderkey AS issue_id", "iteration",
                             "l_returnflag = 'R' AS tests_pass",
                             "CAST(l_quantity AS BIGINT) * 100 AS tokens_used")

    def _build_b_agent_steps(self) -> DataFrame:
        ev = self.table("events").selectExpr(
            "user_id AS run_id", "ts", "event_id",
            "CASE WHEN event_id % 29 = 0 THEN 'DONE' ELSE '/testing:generate-tests' END AS decision",
            "event_id % 31 <> 0 AS decision_ok",
            "event_type <> 'error' AS success")
        ev = row_number_scan(ev, ["run_id"], ["ts", "event_id"], "step", "int")
        return ev.select("run_id", "step", "decision", "decision_ok", "success")

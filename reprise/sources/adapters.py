"""The engine's relations, derived from the star-schema and text tables by fixed rules, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MODELS = ("claude-opus-4-20250514", "gpt-4o-mini-2024", "o3", "some-new-model")  #: by conv_id % 5; the fifth is null
HARNESSES = ("claude_code", "codex", "cursor")
COMMANDS = ("ls -la /tmp", "git status", "rm -rf build", "sudo env A=1 cat x | grep y", "sed -i s/a/b/ f.txt", "git branch -d old && git log", "npm install", "X=1 python run.py; ls")
TOOLS = {"view": "Read", "click": "Grep", "error": "Shell", "purchase": "Edit", "signup": "Write"}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, k):
    out = F.when(F.lit(False), F.lit(""))
    for i, v in enumerate(values):
        out = out.when(k == i, v)
    return out


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations").where("role <> 'system'")
    ts = F.replace((F.expr("timestamp_ntz'2026-08-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), cast(turn as int), 0)")).cast("string"), F.lit(" "), F.lit("T"))
    n = F.when((F.col("role") == "assistant") & (F.col("conv_id") % 4 != 0), F.length("text"))
    key = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))
    return c.select(
        key.alias("session_key"), key.alias("session_id"), F.concat(F.lit("proj-"), (F.col("conv_id") % 7).cast("string")).alias("project"),
        _pick(HARNESSES, F.col("conv_id") % 3).alias("harness"), F.col("turn").alias("ord"), "role", "text", ts.alias("ts"),
        _pick(MODELS, F.when(F.col("role") == "assistant", F.col("conv_id") % 5)).alias("model"), F.floor(n / 3).cast("long").alias("input_tokens"),
        F.floor(n / 4).cast("long").alias("output_tokens"), F.floor(n / 10).cast("long").alias("cache_read_tokens"),
    )


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    name = F.element_at(F.create_map(*[F.lit(x) for kv in TOOLS.items() for x in kv]), F.col("event_type"))
    key = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    return e.select(
        key.alias("session_key"), key.alias("session_id"), _pick(HARNESSES, F.col("user_id") % 3).alias("harness"), F.concat(F.lit("proj-"), (F.col("user_id") % 7).cast("string")).alias("project"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("ord"), name.alias("name"),
        F.when(~F.col("event_type").isin("error"), F.concat(F.lit("/repo/f"), F.col("k").cast("string"), F.lit(".py"))).alias("path"),
        F.when(F.col("event_type") == "error", _pick(COMMANDS, F.col("k") % len(COMMANDS))).alias("command"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as user requests."""
    d = _read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("intent_ord"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("session_id"), F.col("source").alias("project"), F.col("text").alias("raw_text"))


def _case(values, k: str) -> str:
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: CTEs of the same relations.
SQL = f"""
turns AS (SELECT 'conv-' || conv_id AS session_key, 'conv-' || conv_id AS session_id, 'proj-' || (conv_id % 7) AS project, {_case(HARNESSES, "conv_id % 3")} AS harness,
  turn AS ord, role, text, strftime(TIMESTAMP '2026-08-01' + to_hours(conv_id) + to_minutes(turn), '%Y-%m-%dT%H:%M:%S') AS ts,
  {_case(MODELS, "CASE WHEN role = 'assistant' THEN conv_id % 5 END")} AS model,
  CASE WHEN role = 'assistant' AND conv_id % 4 <> 0 THEN length(text) // 3 END AS input_tokens,
  CASE WHEN role = 'assistant' AND conv_id % 4 <> 0 THEN length(text) // 4 END AS output_tokens,
  CASE WHEN role = 'assistant' AND conv_id % 4 <> 0 THEN length(text) // 10 END AS cache_read_tokens
  FROM conversations WHERE role <> 'system'),
tool_calls AS (SELECT 'user-' || user_id AS session_key, 'user-' || user_id AS session_id, {_case(HARNESSES, "user_id % 3")} AS harness, 'proj-' || (user_id % 7) AS project,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TOOLS.items())} END AS name,
  CASE WHEN event_type <> 'error' THEN '/repo/f' || (props->>'$.k') || '.py' END AS path,
  CASE WHEN event_type = 'error' THEN {_case(COMMANDS, f"(props->>'$.k')::BIGINT % {len(COMMANDS)}")} END AS command FROM events),
requests AS (SELECT doc_id AS intent_ord, 'doc-' || doc_id AS session_id, source AS project, text AS raw_text FROM documents)"""

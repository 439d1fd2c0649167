"""Run logs: JSON lines of messages with tool calls and token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "run string, type string, message struct<id: string, content: array<struct<type: string, name: string, id: string, tool_use_id: string, text: string, content: string>>, "
    "usage: struct<input_tokens: long, output_tokens: long, cache_read_input_tokens: long, cache_creation_input_tokens: long>>, subtype string, duration_ms long, total_cost_usd double, num_turns long"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the file that they come from; a fixed schema, so nothing is read twice to infer one."""
    lines = spark.read.schema(SCHEMA).json(path)
    return lines.withColumn("run", F.coalesce("run", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.jsonl?)?$", 1)))


def tool_calls(lines: DataFrame) -> DataFrame:
    """(run, tool, id) for each tool call."""
    return lines.filter("type = 'assistant'").select("run", F.explode("message.content").alias("c")).filter("c.type = 'tool_use'").select("run", F.col("c.name").alias("tool"), F.col("c.id").alias("id"))


def results(lines: DataFrame) -> DataFrame:
    """(run, id, chars): the size of what each call returned."""
    found = lines.filter("type = 'user'").select("run", F.explode("message.content").alias("c")).filter("c.type = 'tool_result'")
    return found.select("run", F.col("c.tool_use_id").alias("id"), F.length(F.coalesce("c.content", "c.text", F.lit(""))).alias("chars"))


def tokens(lines: DataFrame) -> DataFrame:
    """(run, input, output, cached): each message counts once, however many lines repeat its usage."""
    used = lines.filter("message.usage IS NOT NULL").select("run", F.col("message.id").alias("id"), "message.usage").dropDuplicates(["run", "id"])
    total = lambda *fields: F.sum(sum((F.coalesce(f"usage.{f}", F.lit(0)) for f in fields), F.lit(0))).cast("long")
    return used.groupBy("run").agg(total("input_tokens").alias("input"), total("output_tokens").alias("output"), total("cache_read_input_tokens", "cache_creation_input_tokens").alias("cached"))


def metrics(lines: DataFrame) -> DataFrame:
    """One row for each run: calls in all and by kind, what came back, tokens, time and cost."""
    calls = tool_calls(lines).join(results(lines), ["run", "id"], "left")
    by_run = calls.groupBy("run").agg(
        F.count("*").alias("calls"), F.count_if(F.col("tool") == "Read").alias("reads"), F.count_if(F.col("tool").isin("Grep", "Glob")).alias("searches"), F.sum("chars").cast("long").alias("chars")
    )
    ends = lines.filter("type = 'result'").groupBy("run").agg(F.max("duration_ms").alias("ms"), F.max("total_cost_usd").alias("cost"), F.max("num_turns").alias("turns"), F.bool_and(F.col("subtype") == "success").alias("ok"))
    return ends.join(by_run, "run", "left").join(tokens(lines), "run", "left").fillna(0, ["calls", "reads", "searches", "chars", "input", "output", "cached"])


def report(runs: DataFrame, arm) -> DataFrame:
    """Medians of successful runs by arm, and the saving of each measure against the other arm."""
    m = runs.filter("ok").withColumn("arm", arm(F.col("run")))
    return m.groupBy("arm").agg(F.count("*").alias("runs"), *(F.round(F.median(c), 6).alias(c) for c in ("calls", "reads", "ms", "cost")))

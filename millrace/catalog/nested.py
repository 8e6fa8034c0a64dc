"""Queries of the nested-record operator (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.delivery import latest_delivery
from millrace.operators.nested import flat_table, trajectory_links, trajectory_nodes


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    latest = latest_delivery(spark.read.parquet(f"{sf}/trajectories.parquet"), "trajectory_id", "ingested_at")
    return trajectory_nodes(latest, ["trajectory_id"])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return trajectory_links(_nodes(spark, sf))


def p3_tool_args(spark: SparkSession, sf: str) -> DataFrame:
    return flat_table(_nodes(spark, sf), ["trajectory_id"], "tool_arg", ["step_no", "call_no", "arg_no"], ["key", "value"])


def p3_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return flat_table(_nodes(spark, sf), ["trajectory_id"], "tool_output", ["step_no", "output_no"], ["tool_name", "status", "error", "execution_time_ms"])


QUERIES = {f.__name__: f for f in (p3_found, p3_tool_args, p3_outputs)}
SQL: dict[str, str] = {}

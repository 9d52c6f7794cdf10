"""Queries over the streams of container runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provelight.operators.logs import parse_logs
from provelight.store import spread


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.read.parquet(f"{sf_dir}/container_runs.parquet").select("run_id", "started_at", "stdout", "stderr")
    return parse_logs(spread(runs), "run_id", ["stdout", "stderr"], "started_at")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every log entry with its first line, time, level and component."""
    return _parsed(spark, sf_dir).drop("message")


def p4_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every log entry with its message, continuation lines attached."""
    return _parsed(spark, sf_dir)


def p4_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and runs by component and level."""
    return (
        _parsed(spark, sf_dir)
        .groupBy("component", "level")
        .agg(F.count("*").alias("n_entries"), F.max(F.length("message")).alias("longest_message"))
    )


def queries() -> dict:
    return {"p4_found": p4_found, "p4_entries": p4_entries, "p4_levels": p4_levels}


def oracle_sql() -> dict[str, str]:
    return {}

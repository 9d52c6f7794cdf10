"""Queries over the stage-event stream and over the grading pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provelight.operators import aggregate as A
from provelight.operators import verdict as V
from provelight.operators.measure import STATEMENT_FIELDS, STRUCTURE_FIELDS
from provelight.plans import grade as G
from provelight.plans.analysis_queries import statement_health_sql
from provelight.sources.folders import Policy
from provelight.store import shared_dir, spread
from provelight.streaming import stage_log as T


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user and type."""
    e = _read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return V.latest_stages(e, ["user_id"], "event_type", ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type (windows are an addition of this engine)."""
    counts = T.tumbling_counts(_read(spark, sf_dir, "events"), "1 hour", time="ts", kind="event_type")
    return counts.select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start_s"), "event_type", "n")


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from a stream that reads what is there and ends.

    Counts go to a table in the shared folder, batch by batch; a batch that is
    run again replaces its own part.
    """
    schema = _read(spark, sf_dir, "events").schema
    # The stream reads a folder; where the table is one file, the folder holds it.
    whole = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    stream = whole.parquet(f"{sf_dir}/events.parquet*")
    work = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        T.tumbling_counts(batch, "1 hour", time="ts", kind="event_type").write.mode("overwrite").parquet(f"{work}/rows/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.parquet(f"{work}/rows")
    return parts.groupBy(F.unix_seconds(F.col("start").cast("timestamp")).alias("start_s"), "event_type").agg(F.sum("n").alias("n"))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attempt as an answer file, graded against its task as a frozen target.

    An attempt whose model is null takes part as ``(no model)``.
    """
    tasks = _read(spark, sf_dir, "tasks").select("task_id", "formal_statement")
    claim = F.regexp_replace("formal_statement", r"^\s*theorem\s+\S+\s*", "")
    target = F.concat(F.lit("namespace Problem\ndef Target : Prop := ∀ "), F.regexp_replace(claim, r"\) :", "),"), F.lit("\nend Problem\n"))
    problems = tasks.select(F.col("task_id").alias("problem_id"), target.alias("source"))
    body = F.regexp_replace(F.coalesce("proof", F.lit("")), r"(?s)^\s*theorem.*?:=\s*", "")
    head = F.lit("import Mathlib\nnamespace Submission\ntheorem solution : Problem.Target := ")
    answers = spread(_read(spark, sf_dir, "attempts").select("model", "record_id", "task_id", "proof")).select(
        F.concat_ws("#", F.coalesce("model", F.lit("(no model)")), F.col("record_id").cast("string")).alias("participant"),
        F.col("task_id").alias("problem_id"),
        F.concat(head, body, F.lit("\nend Submission\n")).alias("source"),
    )
    return G.grade(answers, problems, G.create("mock", pass_rate=0.4), Policy())


def graded_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by where they were refused and by failure and success mode."""
    return graded(spark, sf_dir).groupBy("refused_at", "failure_mode", "success_mode").agg(F.count("*").alias("n"))


def graded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last events of the graded answers, by stage and status."""
    rows = graded(spark, sf_dir)
    events = G.interface_events(rows).unionByName(G.build_events(rows))
    last = V.latest_stages(events, ["participant", "problem_id"], "stage", ["recorded_at", "ordinal"])
    return last.groupBy("stage", "status").agg(F.count("*").alias("n"))


def statement_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of the statements with the recorded status of their verdicts as elaboration probe."""
    tasks = _read(spark, sf_dir, "tasks").select("task_id", "formal_statement", "header", "language")
    said = F.when(F.col("status") == "ok", "verified").when(F.col("status") == "unfaithful", "failed").otherwise("skipped")
    probed = _read(spark, sf_dir, "verdicts").select("task_id", F.lit("elaborates").alias("probe"), said.alias("status"))
    return G.problem_health(tasks, probed).groupBy("state").agg(F.count("*").alias("n"))


def graded_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of the measures of graded answers by outcome."""
    rows = graded(spark, sf_dir)
    own = {n: F.col(f"structure.{n}") for n in STRUCTURE_FIELDS}
    stated = {f"statement_{n}": F.col(f"statement_complexity.{n}") for n in STATEMENT_FIELDS}
    return A.structure_stats(rows, own | stated, F.col("solved"), F.col("kernel") != "not_run")


def queries() -> dict:
    names = (latest_events, hourly_events, streamed_events, graded_outcomes, graded_events, statement_health, graded_structure)
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    hourly = "select epoch(date_trunc('hour', ts))::bigint start_s, event_type, count(*) n from events where ts is not null group by 1, 2"
    return {
        "latest_events": """select user_id, event_type, event_id, "value" from events
            qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1""",
        "statement_health": statement_health_sql(),
        "hourly_events": hourly,
        "streamed_events": hourly,
    }

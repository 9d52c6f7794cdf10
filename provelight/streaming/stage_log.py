"""The log of stage events as a stream.

Events are (participant, problem_id, stage, status, detail, recorded_at, ordinal).
``latest`` keeps the last state per answer and stage by a stateful aggregate with
a watermark, ``upsert_snapshot`` applies micro-batches to a snapshot table, and
``tumbling_counts`` is an addition of this engine: event-time counts per window.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "participant string, problem_id string, stage string, status string, detail string, recorded_at timestamp, ordinal bigint"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of JSON event files dropped into a folder."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def latest(events: DataFrame, keys: tuple[str, ...] = ("participant", "problem_id", "stage")) -> DataFrame:
    """The last status of each key, by time and ordinal; batch or stream (update mode)."""
    last = F.max_by(F.struct("status", "detail", "recorded_at"), F.struct("recorded_at", "ordinal")).alias("e")
    return events.groupBy(*keys).agg(last).select(*keys, "e.*")


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", time: str = "recorded_at", kind: str = "status") -> DataFrame:
    """(start, end, kind, n) of events per window; a row later than ``late`` is left out by a stream."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    counts = timed.where(F.col(time).isNotNull()).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def next_stages(events: DataFrame) -> DataFrame:
    """Adds ``not_run`` rows for the stages behind a refusal, as the stage machine records them."""
    from provelight import dims
    from provelight.operators.verdict import stage_number

    stopped = events.where("status = 'failed'").groupBy("participant", "problem_id").agg(F.min(stage_number(F.col("stage"))).alias("at"))
    checks = [s for s in dims.STAGES if s not in ("environment", "report")]
    rest = stopped.select("participant", "problem_id", "at", F.explode(F.array(*[F.lit(s) for s in checks])).alias("stage"))
    rest = rest.where(stage_number(F.col("stage")) > F.col("at")).drop("at")
    return events.unionByName(rest.withColumn("status", F.lit("not_run")), allowMissingColumns=True)


def upsert_snapshot(events: DataFrame, path: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None):
    """Start a query that keeps the latest state per key at ``path/<batch>``; the highest number is current.

    A batch that is run again after a failure writes the same number again.
    """
    spark = events.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        done = sorted((int(p.name) for p in Path(path).glob("[0-9]*") if int(p.name) < number), reverse=True)
        old = [spark.read.parquet(str(Path(path) / str(done[0])))] if done else []
        rows = batch.select("participant", "problem_id", "stage", "status", "detail", "recorded_at", "ordinal")
        for table in old:
            rows = rows.unionByName(table)
        keys = ["participant", "problem_id", "stage"]
        last = F.max_by(F.struct("status", "detail", "recorded_at", "ordinal"), F.struct("recorded_at", "ordinal")).alias("e")
        rows.groupBy(*keys).agg(last).select(*keys, "e.*").write.mode("overwrite").parquet(str(Path(path) / str(number)))
        if on_batch:
            on_batch(batch, number)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The current snapshot."""
    newest = max(int(p.name) for p in Path(path).glob("[0-9]*"))
    return spark.read.parquet(str(Path(path) / str(newest)))

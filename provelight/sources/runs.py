"""A grading run on disk: inputs, stage events, graded rows, reports.

Tables are partitioned Parquet written by Spark's commit protocol; the small
reports are single tab-separated files.  Snapshots (latest state, refused only)
are views over the one event log, not copies of it.
"""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime, timezone
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provelight.operators.verdict import latest_stages

_BAD = re.compile(r'[<>:"/\\|?*\x00-\x1f]')


def safe_name(name: str) -> str:
    """The name, refused where it could leave its folder or clash with another."""
    if not name or name in (".", "..") or name != name.strip() or name.endswith(".") or _BAD.search(name):
        raise ValueError(f"invalid name {name!r}")
    return name


def new_run_id() -> str:
    """A UTC time that sorts, and a random end."""
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H%M%S.%fZ") + "-" + uuid.uuid4().hex[:8]


class ArtifactSink(Protocol):
    """What a run is written to."""

    def write_inputs(self, answers: DataFrame) -> None: ...
    def write_screened(self, rows: DataFrame) -> None: ...
    def append_events(self, events: DataFrame) -> None: ...
    def write_graded(self, graded: DataFrame) -> None: ...
    def write_report(self, name: str, report: DataFrame) -> None: ...
    def set_state(self, state: str, **facts: object) -> None: ...


class RunFolder:
    """One run below ``base``; an id that is taken is refused."""

    def __init__(self, base: str, run_id: str | None = None):
        self.root = Path(base) / safe_name(run_id or new_run_id())
        self.root.mkdir(parents=True, exist_ok=False)
        self.set_state("running", started_at=datetime.now(timezone.utc).isoformat())

    def _at(self, name: str) -> str:
        return str(self.root / name)

    def set_state(self, state: str, **facts: object) -> None:
        """running, complete, failed or interrupted; replaces the file in one step."""
        path = self.root / "run.json"
        old = json.loads(path.read_text()) if path.is_file() else {}
        fresh = path.with_suffix(".new")
        fresh.write_text(json.dumps(old | {"state": state} | facts, indent=1) + "\n")
        fresh.replace(path)

    def state(self) -> dict:
        return json.loads((self.root / "run.json").read_text())

    def write_problems(self, problems: DataFrame) -> None:
        """Problems with hash and size, as a table and as a tab-separated list."""
        rows = problems.select("problem_id", F.sha2("source", 256).alias("sha256"), F.octet_length("source").alias("bytes"))
        problems.write.parquet(self._at("problems"))
        self.write_report("problems", rows.orderBy("problem_id"))

    def write_inputs(self, answers: DataFrame) -> None:
        answers.write.partitionBy("participant").parquet(self._at("answers"))

    def append_events(self, events: DataFrame) -> None:
        events.write.mode("append").parquet(self._at("events"))

    def write_screened(self, rows: DataFrame) -> None:
        rows.write.parquet(self._at("screened"))

    def screened(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self._at("screened"))

    def graded(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self._at("graded"))

    def write_graded(self, graded: DataFrame) -> None:
        graded.write.parquet(self._at("graded"))

    def write_report(self, name: str, report: DataFrame) -> None:
        """An aggregate of bounded size as one tab-separated file."""
        rows = report.collect()
        lines = ["\t".join(report.columns)] + ["\t".join("" if v is None else str(v) for v in r) for r in rows]
        (self.root / f"{safe_name(name)}.tsv").write_text("\n".join(lines) + "\n", encoding="utf-8")

    def events(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self._at("events"))

    def snapshot(self, spark: SparkSession) -> DataFrame:
        """The latest event of each answer and stage."""
        return latest_stages(self.events(spark), ["participant", "problem_id"], "stage", ["recorded_at", "ordinal"])

    def refused(self, spark: SparkSession) -> DataFrame:
        return self.events(spark).where("status = 'failed'")

    def unfinished(self, spark: SparkSession) -> DataFrame:
        """Stages whose last event is still running: where the run was interrupted."""
        return self.snapshot(spark).where("status = 'running'")


def text_table(df: DataFrame, limit: int = 10, order: list | None = None) -> str:
    """The first rows of a report as aligned text, and how many more there are."""
    rows = (df.orderBy(*order) if order else df).limit(limit).collect()
    total = df.count()
    cells = [df.columns] + [["" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r] for r in rows]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells]
    return "\n".join([*lines, f"+ {total - len(rows)} more"] if total > len(rows) else lines)

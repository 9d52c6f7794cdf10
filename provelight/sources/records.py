"""Serialized records: JSON lines in, JSON lines out, checked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provelight import dims
from provelight.operators.nested import json_object

SCHEMAS = {
    "tasks": "task_id string, formal_statement string, header string, language string, assembly string, split string, timeout_s double",
    "attempts": "task_id string, proof string, attempt_id string, model string, sample_index int",
    "results": (
        "task_id string, attempt_id string, backend string, status string, error_kind string, "
        "soundness struct<ok: boolean, violations: array<string>>, diagnostics array<struct<severity: string, message: string, "
        "line: int, column: int, kind: string>>, wall_time_s double, compile_time_s double, model string, sample_index int, "
        "split string, cached boolean, tactics array<string>, failure_mode string, success_mode string"
    ),
    "verdicts": (
        "task_id string, status string, checks array<struct<kind: string, passed: boolean, detail: string, fatal: boolean>>, "
        "judge struct<label: string, reasoning: string, confidence: double, samples: array<string>, aggregation: string>, backend string, "
        "wall_time_s double, split string"
    ),
}


class BadRecord(ValueError):
    """A line that is no JSON object; names file and line."""


def read_jsonl(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Objects of a JSON-lines file or folder, or of a file that is one JSON array.

    Blank lines and lines that begin with ``//`` are skipped; any other line that
    is no JSON object raises ``BadRecord``.  Without ``kind`` the result has one
    variant column ``record``; with it the columns of that record type and a map
    ``metadata`` of all other fields as JSON text.
    """
    whole = spark.read.text(path, wholetext=True)
    lead = F.substring(F.regexp_replace("value", r"(?s)^\s*(\S).*$", "$1"), 1, 1)
    listed = whole.where(lead == "[").select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("v"))
    if listed.isEmpty():
        # Line numbers within a file need its lines in order, so each file is split where it is read.
        lines = whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r\n|\n")).alias("i", "line"))
        trimmed = F.trim("line")
        rows = lines.where((trimmed != "") & ~trimmed.startswith("//")).select("file", "i", json_object(F.col("line")).alias("v"))
    else:
        items = listed.select("file", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("i", "item"))
        whole_object = F.try_variant_get("item", "$", "map<string,variant>").isNotNull()
        rows = items.select("file", "i", F.when(whole_object, F.col("item")).alias("v"))
    bad = rows.where("v is null").orderBy("file", "i").limit(1).collect()
    if bad:
        raise BadRecord(f"{bad[0]['file']}:{bad[0]['i'] + 1}: not a JSON object")
    if kind is None:
        return rows.select(F.col("v").alias("record"))
    return from_variant(rows, "v", kind)


def from_variant(df: DataFrame, column: str, kind: str) -> DataFrame:
    """The fields of a record type as columns; fields of other names go to ``metadata``."""
    schema = T.StructType.fromDDL(SCHEMAS[kind])
    get = lambda f: F.try_variant_get(column, f"$.{f.name}", f.dataType.simpleString())
    fields = F.try_variant_get(column, "$", "map<string,variant>")
    rest = F.map_filter(fields, lambda k, _: ~k.isin(*schema.names))
    own = F.try_variant_get(column, "$.metadata", "map<string,string>")
    as_text = F.transform_values(F.map_filter(rest, lambda k, _: k != "metadata"), lambda _, v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))
    empty = F.create_map().cast("map<string,string>")
    merged = F.map_concat(F.coalesce(own, empty), F.map_filter(as_text, lambda k, _: ~F.map_contains_key(F.coalesce(own, empty), k)))
    return df.select(*[get(f).alias(f.name) for f in schema.fields], merged.alias("metadata"))


def write_jsonl(df: DataFrame, path: str) -> int:
    """Write every row as one JSON line; returns the number of rows."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return df.sparkSession.read.text(path).count()


def capped_diagnostics(diagnostics: Column, most: int = 5) -> Column:
    """The first diagnostics of a build record, as they are serialized."""
    return F.slice(diagnostics, 1, most)


_CHECKS = {
    "tasks": [("task_id", lambda c: F.trim(F.coalesce(c("task_id"), F.lit(""))) != ""), ("assembly", lambda c: c("assembly").isNull() | c("assembly").isin("full_file", "continue_statement", "header_plus_proof"))],
    "attempts": [("task_id", lambda c: F.trim(F.coalesce(c("task_id"), F.lit(""))) != ""), ("sample_index", lambda c: F.coalesce(c("sample_index") >= 0, F.lit(True)))],
    "results": [("status", lambda c: F.coalesce(c("status").isin(*dims.STATUSES), F.lit(False)))],
}


def validate(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with ``problems``): blank ids, negative indexes, unknown enums."""
    found = F.array_compact(F.array(*[F.when(~rule(F.col), F.lit(name)) for name, rule in _CHECKS[kind]]))
    marked = df.withColumn("problems", found)
    return marked.where(F.size("problems") == 0).drop("problems"), marked.where(F.size("problems") > 0)


def fill_attempt_ids(df: DataFrame) -> DataFrame:
    """Attempts without an id get ``task#sample``."""
    made = F.concat("task_id", F.lit("#"), F.coalesce("sample_index", F.lit(0)).cast("string"))
    return df.withColumn("attempt_id", F.coalesce(F.nullif("attempt_id", F.lit("")), made))


def fingerprint(*parts: Column, length: int = 16) -> Column:
    """The first characters of the sha256 of the parts, each with its length before it."""
    safe = [F.concat(F.length(F.coalesce(p, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts]
    return F.substring(F.sha2(F.concat(*safe), 256), 1, length)

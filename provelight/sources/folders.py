"""Benchmarks and submissions kept as folders of Lean files."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provelight import dims
from provelight.functions.lean import parse_column

# Fields of a problem's header block that have columns of their own.
HEADER_FIELDS = "mathdb_id prose source source_locator source_version difficulty author checked contamination notes".split()


def _stem(path: Column, suffix: str) -> Column:
    name = F.url_decode(F.element_at(F.split(path, "/"), -1))
    return F.regexp_replace(name, f"{suffix.replace('.', chr(92) + '.')}$", "")


def read_problems(spark: SparkSession, root: str, suffix: str = ".lean") -> DataFrame:
    """(problem_id, source, origin, content_hash) of each file in one directory; none is an error."""
    folder = Path(root) / "problems" if (Path(root) / "problems").is_dir() else Path(root)
    if not folder.is_dir():
        raise FileNotFoundError(f"{folder} is no directory")
    if not any(p.suffix == suffix for p in folder.iterdir()):
        raise ValueError(f"{folder} has no {suffix} files")
    files = spark.read.option("pathGlobFilter", f"*{suffix}").text(str(folder), wholetext=True)
    path = F.col("_metadata.file_path")
    return files.select(_stem(path, suffix).alias("problem_id"), F.col("value").alias("source"), path.alias("origin")).withColumn(
        "content_hash", F.sha2("source", 256)
    )


@dataclass
class Submissions:
    """answers(participant, problem_id, source), unrecognized(participant, file) and all participants."""

    answers: DataFrame
    unrecognized: DataFrame
    participants: list[str] = field(default_factory=list)


def read_submissions(spark: SparkSession, root: str, problems: DataFrame, suffix: str = ".lean") -> Submissions:
    """Answers at ``root/<participant>/<problem><suffix>``.

    Files for no known problem, or with another suffix, are unrecognized;
    housekeeping files and deeper folders are ignored.  A participant without
    any file stays in ``participants``.
    """
    people = sorted(p.name for p in Path(root).iterdir() if p.is_dir())
    if not people:
        empty = spark.createDataFrame([], "participant string, problem_id string, source string")
        return Submissions(empty, empty.select("participant", F.col("problem_id").alias("file")), [])
    files = spark.read.format("binaryFile").load([str(Path(root) / p) for p in people])
    parts = F.split(F.url_decode("path"), "/")
    rows = files.select(F.element_at(parts, -2).alias("participant"), F.element_at(parts, -1).alias("file"), "content")
    rows = rows.where(~F.lower("file").isin(*dims.HOUSEKEEPING)).withColumn("problem_id", F.when(F.col("file").endswith(suffix), _stem(F.col("file"), suffix)))
    known = problems.select("problem_id", F.lit(True).alias("_known"))
    met = rows.join(known, "problem_id", "left")
    answers = met.where("_known").select("participant", "problem_id", F.decode("content", "UTF-8").alias("source"))
    return Submissions(answers, met.where("_known is null").select("participant", "file"), people)


def header_fields(source: Column) -> Column:
    """Map of the ``key: value`` lines in a file's module comments, keys in lower case, first value wins."""
    blocks = F.regexp_extract_all(source, F.lit(r"/-!((?:.|\n)*?)-/"), F.lit(1))
    line = r"(?m)^[ \t]*[-*]?[ \t]*([A-Za-z_][A-Za-z0-9_]*)[ \t]*:[ \t]*(\S.*?)[ \t]*$"
    text = F.array_join(blocks, "\n")
    keys = F.transform(F.regexp_extract_all(text, F.lit(line), F.lit(1)), F.lower)
    values = F.transform(F.regexp_extract_all(text, F.lit(line), F.lit(2)), F.trim)
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    first = F.filter(pairs, lambda x, i: F.array_position(keys, x["k"]) == i + 1)
    return F.map_from_entries(F.transform(first, lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value"))))


def problem_metadata(problems: DataFrame) -> DataFrame:
    """Adds header fields, what is left of them, the target's tags, and whether provenance is recorded."""
    work = problems.withColumn("_h", header_fields(F.col("source"))).withColumn("_d", parse_column(F.col("source"))["declarations"])
    target = F.coalesce(
        F.get(F.filter("_d", lambda d: d["qualified_name"] == "Problem.Target"), F.lit(0)),
        F.get(F.filter("_d", lambda d: d["is_statement"]), F.lit(0)),
    )
    out = work.withColumn("_t", target)
    value = lambda k: F.coalesce(F.try_element_at("_h", F.lit(k)), F.lit(""))
    named = {("declared_source" if k == "source" else k): value(k) for k in HEADER_FIELDS}
    rest = F.map_filter("_h", lambda k, v: ~k.isin("problem_id", *HEADER_FIELDS))
    declared = F.try_element_at("_h", F.lit("problem_id"))
    extra = F.when(declared.isNotNull(), F.map_concat(rest, F.create_map(F.lit("declared_problem_id"), declared))).otherwise(rest)
    return out.select(
        *problems.columns,
        *[c.alias(n) for n, c in named.items()],
        extra.alias("extra"),
        F.col("_t.qualified_name").alias("theorem_name"),
        F.coalesce("_t.categories", F.array().cast("array<string>")).alias("categories"),
        F.coalesce("_t.ams_tags", F.array().cast("array<string>")).alias("ams_tags"),
        F.coalesce("_t.answer_holes", F.lit(0)).alias("answer_holes"),
        ((value("mathdb_id") != "") | (value("source") != "")).alias("has_provenance"),
    )


@dataclass(frozen=True)
class Policy:
    """What answers may import, declare and depend on."""

    allowed_imports: tuple[str, ...] = ("Mathlib",)
    allowed_axioms: tuple[str, ...] = dims.ALLOWED_AXIOMS
    allow_global_instances: bool = True
    isolate_builds: bool = True
    require_replay: bool = False

    def __post_init__(self) -> None:
        if not self.isolate_builds:
            raise ValueError("answers are built apart from one another; isolate_builds cannot be off")


@dataclass(frozen=True)
class Manifest:
    """Declared facts of a benchmark; all empty where no file is there."""

    name: str = ""
    version: str = ""
    language: str = "lean4"
    description: str = ""
    lean: str = ""
    mathlib_rev: str = ""
    raw: dict = field(default_factory=dict)

    @property
    def declares_toolchain(self) -> bool:
        return bool(self.lean or self.mathlib_rev)

    @property
    def policy(self) -> Policy:
        """The policy block, refused where a field is unknown or of the wrong type."""
        data = self.raw.get("policy", {})
        if not isinstance(data, dict):
            raise ValueError("policy must be an object")
        types = {"allowed_imports": list, "allowed_axioms": list, "allow_global_instances": bool, "isolate_builds": bool, "require_replay": bool}
        if odd := sorted(set(data) - set(types)):
            raise ValueError(f"unknown policy fields: {', '.join(odd)}")
        for name, value in data.items():
            fine = isinstance(value, types[name]) and (types[name] is bool or all(isinstance(v, str) and v for v in value))
            if not fine:
                raise ValueError(f"{name} must be a {'boolean' if types[name] is bool else 'list of non-empty names'}")
        return Policy(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})


def read_manifest(root: str) -> Manifest:
    """``benchmark.json`` in or beside a folder; a missing file gives an empty manifest."""
    for path in (Path(root) / "benchmark.json", Path(root).parent / "benchmark.json"):
        if path.is_file():
            data = json.loads(path.read_text(encoding="utf-8"))
            tool = data.get("toolchain") or {}
            text = lambda d, k, o="": str(d.get(k) or o)
            return Manifest(
                text(data, "name"), text(data, "version"), text(data, "language", "lean4"), text(data, "description"),
                text(tool, "lean") or text(data, "lean"), text(tool, "mathlib_rev") or text(data, "mathlib_rev"), data,
            )
    return Manifest()


def environment_mismatches(declared: Manifest, observed: dict[str, str]) -> list[str]:
    """Pins that the observed toolchain doesn't meet; a pin nothing was observed for is one."""
    out = []
    for name, want in (("lean", declared.lean), ("mathlib_rev", declared.mathlib_rev)):
        got = observed.get(name) or ""
        if want and got != want:
            out.append(f"{name}: declared {want}, observed {got or 'nothing'}")
    return out


def observed_environment(spark: SparkSession, folder: str) -> DataFrame:
    """One row of what a run is made with: pins of the project folder, versions of Python and Spark, platform."""
    import platform

    pins = project_versions(folder)
    facts = {
        "lean": pins.get("lean"),
        "mathlib_rev": pins.get("mathlib_rev"),
        "lake_manifest_sha256": pins.get("lake_manifest_sha256"),
        "python": platform.python_version(),
        "spark": spark.version,
        "platform": platform.platform(),
    }
    return spark.createDataFrame([tuple(facts.values())], ", ".join(f"{name} string" for name in facts))


def reconcile(declared: Manifest, observed: dict[str, str]) -> dict[str, str]:
    """The pins a run goes by: declared ones first, observed ones where nothing is declared; never an error."""
    return {k: v for k, v in {**observed, **{n: w for n, w in (("lean", declared.lean), ("mathlib_rev", declared.mathlib_rev)) if w}}.items() if v}


def project_versions(folder: str) -> dict[str, str]:
    """Toolchain and dependency pins of a Lake project folder; what is not there is left out."""
    import hashlib

    out: dict[str, str] = {}
    tool, lake = Path(folder) / "lean-toolchain", Path(folder) / "lake-manifest.json"
    if tool.is_file():
        out["lean"] = tool.read_text(encoding="utf-8").strip()
    if lake.is_file():
        data = lake.read_bytes()
        out["lake_manifest_sha256"] = hashlib.sha256(data).hexdigest()
        for p in json.loads(data).get("packages", []):
            if p.get("name") == "mathlib":
                out["mathlib_rev"] = str(p.get("rev") or "")
    return out


def freeze(problems: DataFrame, path: str) -> DataFrame:
    """A frozen copy of a problem table; an id that occurs twice, or is blank, is an error."""
    bad = problems.groupBy("problem_id").count().where("count > 1 or problem_id is null or trim(problem_id) = ''").limit(1).collect()
    if bad:
        raise ValueError(f"problem id {bad[0]['problem_id']!r} is blank or not unique")
    problems.write.mode("errorifexists").parquet(path)
    return problems.sparkSession.read.schema(problems.schema).parquet(path)


def list_folder(root: str) -> list[str]:
    return sorted(os.listdir(root))

"""Command line: grade a folder, audit a problem set or its health, list verifiers and judges, examine the surroundings.

Exit codes: 0 done, 2 bad input, 5 with --strict and an unsolved answer, 130 interrupted.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from provelight.operators import verdict as V
from provelight.plans import grade as G
from provelight.session import local_session
from provelight.sources.folders import environment_mismatches, observed_environment, problem_metadata, project_versions, read_manifest, read_problems, read_submissions
from provelight.sources.runs import text_table


def _options(pairs: list[str]) -> dict:
    """``key=value`` pairs, values as JSON where they parse."""
    out = {}
    for pair in pairs:
        key, mark, value = pair.partition("=")
        if not mark or not key:
            raise ValueError(f"expected key=value, got {pair!r}")
        try:
            out[key] = json.loads(value)
        except ValueError:
            out[key] = value
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="provelight", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    g = sub.add_parser("grade", help="grade submissions against a benchmark folder")
    g.add_argument("benchmark")
    g.add_argument("submissions")
    g.add_argument("--out", default="runs")
    g.add_argument("--verifier", default="mock")
    g.add_argument("--option", action="append", default=[], metavar="KEY=VALUE")
    g.add_argument("--strict", action="store_true")
    a = sub.add_parser("audit", help="what a problem folder records about its problems")
    a.add_argument("benchmark")
    h = sub.add_parser("health", help="what is wrong with the problems themselves")
    h.add_argument("benchmark")
    h.add_argument("--probes", help="table (Parquet) of recorded probes: task_id, probe, status")
    h.add_argument("--strict", action="store_true", help="exit with 5 if a problem is ungradeable or suspect")
    d = sub.add_parser("doctor", help="declared and observed pins of a benchmark folder")
    d.add_argument("benchmark")
    sub.add_parser("verifiers", help="known verifiers")
    sub.add_parser("judges", help="known judges")
    return top


def main(args: list[str] | None = None) -> int:
    try:
        got = parser().parse_args(args)
        if got.command == "verifiers":
            print("\n".join(G.available()))
            return 0
        if got.command == "judges":
            print("\n".join(G.judges.available()))
            return 0
        spark = local_session("*")
        if got.command == "doctor":
            manifest = read_manifest(got.benchmark)
            print(text_table(observed_environment(spark, got.benchmark)))
            wrong = environment_mismatches(manifest, project_versions(got.benchmark))
            print("\n".join(wrong or ["nothing declared is unmet"]))
            return 5 if wrong else 0
        problems = read_problems(spark, got.benchmark)
        if got.command == "audit":
            facts = problem_metadata(problems).select("problem_id", "theorem_name", "has_provenance", "answer_holes")
            print(text_table(facts, 50, ["problem_id"]))
            return 0
        if got.command == "health":
            tasks = problems.select(F.col("problem_id").alias("task_id"), F.col("source").alias("formal_statement"), F.lit("").alias("header"), F.lit("lean4").alias("language"))
            probed = spark.read.parquet(got.probes) if got.probes else spark.createDataFrame([], "task_id string, probe string, status string")
            found = G.problem_health(tasks, probed)
            print(text_table(found.groupBy("state").count(), 10, ["state"]), text_table(V.health_summary(found, "checks"), 10, ["kind"]), sep="\n\n")
            bad = found.where("state in ('ungradeable', 'suspect')")
            print(text_table(bad.select("task_id", "state"), 50, ["task_id"]))
            return 5 if got.strict and not bad.isEmpty() else 0
        verifier = G.create(got.verifier, **_options(got.option))
        folder, made = G.run(got.out, problems, read_submissions(spark, got.submissions, problems), verifier, read_manifest(got.benchmark).policy)
        print(text_table(made.summary), text_table(made.leaderboard, 20, [F.col("rank").asc_nulls_last()]), text_table(made.reasons, 8), folder.root, sep="\n\n")
        total = made.summary.first()
        return 5 if got.strict and total["solved"] < total["answers"] else 0
    except (ValueError, FileNotFoundError, KeyError) as wrong:
        print(f"error: {wrong}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())

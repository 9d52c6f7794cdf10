"""From answer files to graded rows and a report.

The stages are DataFrames: answers meet their problem, the text is screened, what
passes is built by a verifier, axioms are audited, every answer is measured and
classified.  Provers stay outside: a verifier is a function from answers to
build rows, and two are here, one driven by markers and one that reads recorded
builds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provelight import dims
from provelight.functions.lean import binder_names, parse_column, parse_file, theorem_column
from provelight.functions.text import rstrip
from provelight.operators import aggregate as A
from provelight.operators import verdict as V
from provelight.operators.classify import error_messages, failure_mode, success_mode
from provelight.operators.measure import add_statement, add_structure
from provelight.operators.screen import add_interface_report, add_violations, axiom_violations, label_parts
from provelight.sources.folders import Policy, Submissions
from provelight.sources.runs import RunFolder
from provelight.store import keep

BUILD = (
    "participant string, problem_id string, status string, failed_stage string, axioms array<string>, "
    "diagnostics array<struct<severity: string, message: string, line: int, column: int, kind: string>>, compile_time_s double"
)
#: participant, problem_id, source, module -> rows of BUILD
Verifier = Callable[[DataFrame], DataFrame]
#: rows with task_id, informal_statement, formal_statement, metadata -> the same with label
Judge = Callable[[DataFrame], DataFrame]


class Registry:
    """Factories by name."""

    def __init__(self, kind: str):
        self.kind, self.known = kind, {}

    def register(self, name: str, factory: Callable) -> None:
        self.known[name] = factory

    def create(self, name: str, **options):
        if name not in self.known:
            raise KeyError(f"no {self.kind} {name!r}; known: {', '.join(self.available())}")
        return self.known[name](**options)

    def available(self) -> list[str]:
        return sorted(self.known)


verifiers, judges = Registry("verifier"), Registry("judge")
create, available = verifiers.create, verifiers.available


def mock_verifier(seed: str = "provelight", pass_rate: float | None = None) -> Verifier:
    """Verdicts from markers in the source, else by a stable draw; nothing is proved."""

    def verify(answers: DataFrame) -> DataFrame:
        v = V.mock_verdict(F.col("source"), F.col("source"), seed, pass_rate)
        ok = v["status"] == "verified"
        message = F.struct(F.lit("error").alias("severity"), F.concat(F.lit("stand-in verdict: "), v["status"]).alias("message"), F.lit(1).alias("line"), F.lit(None).cast("int").alias("column"), v["error_kind"].alias("kind"))
        return answers.select(
            "participant", "problem_id", v["status"].alias("status"), F.when(~ok, "kernel").alias("failed_stage"),
            F.when(ok, F.array().cast("array<string>")).alias("axioms"), F.when(~ok, F.array(message)).alias("diagnostics"), F.lit(0.0).alias("compile_time_s"),
        )

    return verify


def replay_verifier(builds: DataFrame) -> Verifier:
    """Verdicts from recorded builds; answers without a record were not built."""
    return lambda answers: answers.select("participant", "problem_id").join(builds, ["participant", "problem_id"])


def mock_judge(seed: str = "provelight", faithful_rate: float | None = None) -> Judge:
    """Labels from metadata or markers, else by a stable draw; statements without prose are not judged (NULL)."""

    def judge(tasks: DataFrame) -> DataFrame:
        label = V.mock_judgement(F.col("formal_statement"), F.try_element_at("metadata", F.lit("mock_judge")), seed, faithful_rate)
        prose = F.trim(F.coalesce("informal_statement", F.lit(""))) != ""
        return tasks.withColumn("label", F.when(prose, F.nullif(label, F.lit("error"))))

    return judge


verifiers.register("mock", mock_verifier)
verifiers.register("replay", replay_verifier)
judges.register("mock", mock_judge)

# What a probe tries on a goal.
TRIVIAL_TACTICS = ("trivial", "rfl", "simp", "decide", "norm_num", "omega", "tauto")
VACUITY_TACTICS = ("omega", "simp_all", "exact absurd rfl (by decide)", "linarith", "tauto")
GOLD_TACTICS = "rfl | simp | tauto | constructor <;> intro h <;> simpa using h"


def add_probes(tasks: DataFrame) -> DataFrame:
    """Adds the texts that ask a prover about a statement, NULL where a question does not apply.

    ``elaborates`` (the statement left open), ``trivial`` (cheap tactics close
    it), ``vacuous`` (its hypotheses give False; needs binders), and
    ``gold_equivalent`` (equivalent to ``gold_formal_statement`` over the same
    binders).
    """
    work = tasks.withColumn("_t", theorem_column(F.col("formal_statement"))).withColumn("_g", theorem_column(F.col("gold_formal_statement")))
    t, g = F.col("_t"), F.col("_g")
    head = lambda name: F.concat(t["keyword"], F.lit(f" {name} "), F.when(t["binders"] != "", F.concat(t["binders"], F.lit(" "))).otherwise(""), F.lit(": "))
    file = lambda body: F.concat(F.concat_ws("\n\n", F.nullif(rstrip(F.coalesce("header", F.lit(""))), F.lit("")), body), F.lit("\n"))
    proof = lambda tactics: F.lit(f" := by\n  first | {tactics}")
    whole = rstrip(F.col("formal_statement"))
    left_open = F.when(whole.contains(":="), F.concat(whole, F.lit(" sorry"))).otherwise(F.concat(whole, F.lit(" := sorry")))
    squeezed = lambda b: F.regexp_replace(b, r"\s+", " ")
    both = F.concat(F.lit("("), t["conclusion"], F.lit(") ↔ ("), g["conclusion"], F.lit(")"))
    ask = lambda when, body: F.when(when, file(body))
    return work.select(
        *tasks.columns,
        ask(whole.isNotNull(), left_open).alias("elaborates"),
        ask(t.isNotNull(), F.concat(head("trivial_probe"), t["conclusion"], proof(" | ".join(TRIVIAL_TACTICS)))).alias("trivial"),
        ask(t["binders"] != "", F.concat(head("vacuous_probe"), F.lit("False"), proof(" | ".join(VACUITY_TACTICS)))).alias("vacuous"),
        ask(squeezed(t["binders"]) == squeezed(g["binders"]), F.concat(head("gold_probe"), both, proof(GOLD_TACTICS))).alias("gold_equivalent"),
    )


def interface_problems(problems: DataFrame, strict: bool = True) -> DataFrame:
    """(problem_id, target_parameters, statement) of each problem's frozen target.

    With ``strict`` a problem without exactly one ``Problem.Target : Prop`` raises.
    """

    @F.pandas_udf("array<string>")
    def names(signatures: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else binder_names(s) for s in signatures])

    decls = parse_column(F.col("source"))["declarations"]
    targets = F.filter(decls, lambda d: d["qualified_name"] == "Problem.Target")
    rows = problems.select("problem_id", targets.alias("t"))
    target = F.get("t", F.lit(0))
    typed = target["signature"].rlike(r"(^|.*\s)?:\s*Prop\s*$")
    fine = (F.size("t") == 1) & target["kind"].isin("def", "abbrev") & typed
    if strict:
        bad = rows.where(~F.coalesce(fine, F.lit(False))).select("problem_id").limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0]['problem_id']}: exactly one Problem.Target of type Prop is needed")
    statement = F.concat(F.regexp_replace(target["signature"], r":\s*Prop\s*$", ""), F.lit(": "), target["body"])
    return rows.select("problem_id", names(target["signature"]).alias("target_parameters"), statement.alias("statement"))


def screened(answers: DataFrame, problems: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Answers with the frozen target of their problem and the faults of their text."""
    policy = policy or Policy()
    module = F.concat(F.lit("Bench."), F.col("problem_id"))
    rows = answers.join(interface_problems(problems), "problem_id").withColumn("module", module)
    return add_interface_report(rows, "source", F.col("module"), F.size("target_parameters") > 0, policy.allowed_imports, policy.allow_global_instances)


def grade(answers: DataFrame, problems: DataFrame, verifier: Verifier, policy: Policy | None = None) -> DataFrame:
    """One graded row per answer: faults, build, audit, verdict, measures, mode.

    An answer with faults is refused before the verifier sees it; one whose build
    or audit is missing is not solved, but not refused for it either.
    """
    # Both the verifier and the graded rows read the screened answers.
    return judged(keep(screened(answers, problems, policy), "screened"), verifier, policy)


STAGE = "array<struct<stage: string, status: string>>"


def judged(rows: DataFrame, verifier: Verifier, policy: Policy | None = None) -> DataFrame:
    """``screened`` answers with builds, audit, verdict, measures and mode.

    A verifier may add ``stages`` (what it observed of kernel, replay and
    dependencies) to its rows.  Where the policy requires a replay, a verified
    build without a passed one is an error of stage ``replay``.
    """
    policy = policy or Policy()
    clean = rows.where(F.size("faults") == 0)
    builds = verifier(clean.select("participant", "problem_id", "source", "module"))
    if "stages" not in builds.columns:
        builds = builds.withColumn("stages", F.array().cast(STAGE))
    stages = F.coalesce(F.col("stages").cast(STAGE), F.array().cast(STAGE))
    replayed = F.exists(stages, lambda e: (e["stage"] == "replay") & (e["status"] == "passed"))
    unmet = F.lit(policy.require_replay) & (F.col("status") == "verified") & ~replayed
    build = F.struct(
        F.when(unmet, "error").otherwise(F.col("status")).alias("status"), F.when(unmet, "replay").otherwise(F.col("failed_stage")).alias("failed_stage"),
        "axioms", "diagnostics", "compile_time_s", stages.alias("stages"),
    )
    # Only the build meets the answers' keys; sources stay on their side of the join.
    rows = rows.join(builds.select("participant", "problem_id", build.alias("build")), ["participant", "problem_id"], "left")
    passed = F.col("build.status") == "verified"
    audit = F.when(passed, axiom_violations(F.col("build.axioms"), policy.allowed_axioms))
    rows = rows.withColumn("audit", audit).withColumn("audit_ok", F.when(passed & F.col("build.axioms").isNotNull(), F.size("audit") == 0))
    seen = F.coalesce("build.stages", F.array().cast(STAGE))
    rows = (
        rows.withColumn("solved", V.solved(F.col("faults"), F.col("build.status"), F.col("audit_ok")))
        .withColumn("refused_at", V.refused_at(F.col("faults"), seen, F.col("build.status"), F.col("build.failed_stage"), F.col("audit_ok")))
        .withColumn("kernel", V.kernel_status(seen, F.col("build.status")))
    )
    first = F.get(F.filter("build.diagnostics", lambda d: F.coalesce(d["message"], F.lit("")) != ""), F.lit(0))["message"]
    reason = (
        F.when(F.size("faults") > 0, F.get("faults", F.lit(0))["detail"])
        .when(F.col("build").isNull(), "kernel check not run")
        .when(F.col("build.status") != "verified", F.coalesce(first, F.col("build.status")))
        .when(F.col("build.axioms").isNull(), "axiom audit not run")
        .when(~F.col("audit_ok"), F.array_join("audit", "; "))
        .otherwise("kernel checked the frozen target; axiom audit passed")
    )
    return _measured(rows.withColumn("reason", reason))


def _measured(rows: DataFrame) -> DataFrame:
    """Adds tactics, structure, statement measures, failure and success mode."""
    rows = rows.withColumn("proof", F.coalesce(F.nullif("solution_body", F.lit("")), F.col("source"))).drop("solution_body")
    rows = add_statement(add_structure(rows, "proof"), "statement")
    audit_rules = F.transform(F.coalesce("audit", F.array().cast("array<string>")), lambda v: F.struct(*[p.alias(n) for p, n in zip(label_parts(v), ("c", "r"), strict=True)]))
    hacked = F.exists("faults", lambda f: f["fault"] == "reward_hacking") | F.exists(audit_rules, lambda a: a["c"] != "placeholder")
    incomplete = V.fault_kinds(F.col("faults"))[2] | F.exists(audit_rules, lambda a: a["r"] == "kernel.sorry_ax")
    unaudited = F.exists(audit_rules, lambda a: a["r"] == "kernel.audit_missing")
    errors = F.transform(F.coalesce("build.diagnostics", F.array().cast("array<struct<severity: string, message: string, line: int, column: int, kind: string>>")), lambda d: d.withField("severity", F.lit("error")))
    rows = rows.withColumn("_messages", error_messages(errors))
    observed = failure_mode(F.when(hacked, "rejected").otherwise("failed"), F.lit(None).cast("string"), F.col("_messages"), F.col("proof"), ~hacked)
    mode = F.when(F.col("solved"), F.lit(None).cast("string")).when(incomplete & ~hacked, "placeholder_left").when(unaudited & ~hacked, "harness_error").otherwise(observed)
    s = F.col("structure")
    success = success_mode(F.col("tactics"), s["named_steps"], s["term_mode"], s["auxiliary_declarations"], s["calc_blocks"])
    return rows.withColumn("failure_mode", mode).withColumn("success_mode", F.when(F.col("solved"), success)).drop("statement", "_messages")


def interface_events(rows: DataFrame) -> DataFrame:
    """The event of the text check of each screened answer."""
    fine = F.size("faults") == 0
    detail = F.coalesce(F.get("faults", F.lit(0))["fault"], F.lit(""))
    return rows.select(
        "participant", "problem_id", F.lit("interface").alias("stage"), F.when(fine, "passed").otherwise("failed").alias("status"),
        detail.alias("detail"), F.current_timestamp().alias("recorded_at"), F.lit(0).cast("bigint").alias("ordinal"),
    )


def build_events(graded: DataFrame) -> DataFrame:
    """The events behind the text check, four of each graded answer: kernel, replay, dependencies, axioms."""
    refused = F.size("faults") > 0
    seen = lambda stage: F.element_at(F.filter(F.coalesce("build.stages", F.array().cast(STAGE)), lambda e: (e["stage"] == stage) & (e["status"] != "running")), -1)["status"]
    has = lambda stage: F.exists(F.coalesce("build.stages", F.array().cast(STAGE)), lambda e: (e["stage"] == stage) & (e["status"] != "running"))
    observed = lambda stage: F.when(has(stage), seen(stage)).otherwise("not_run")
    audit = F.when(F.col("audit").isNull(), "not_run").when(F.size("audit") == 0, "passed").otherwise("failed")
    statuses = [("kernel", F.col("kernel")), ("replay", observed("replay")), ("dependencies", observed("dependencies")), ("axioms", audit)]
    event = lambda k, stage, status: F.struct(
        F.lit(stage).alias("stage"), F.when(refused, "not_run").otherwise(status).alias("status"),
        F.when(refused, "interface refused").otherwise("").alias("detail"), F.lit(k).cast("bigint").alias("ordinal"),
    )
    each = F.explode(F.array(*[event(k, *s) for k, s in enumerate(statuses, 1)]))
    events = graded.select("participant", "problem_id", each.alias("e"))
    return events.select("participant", "problem_id", "e.stage", "e.status", "e.detail", F.current_timestamp().alias("recorded_at"), "e.ordinal")


def problem_health(tasks: DataFrame, probed: DataFrame) -> DataFrame:
    """(task_id, checks, state) of statements from their screening and recorded probes (task_id, probe, status).

    A statement nobody probed has its text checked only.  ``tasks`` has task_id,
    formal_statement, header, language and may have gold_formal_statement.
    """
    text = F.concat_ws("\n", "header", "formal_statement")
    gold = F.col("gold_formal_statement").isNotNull() if "gold_formal_statement" in tasks.columns else F.lit(False)
    rows = add_violations(tasks.select("task_id", "language", text.alias("source"), gold.alias("has_gold")), "source", F.col("language"), None, dims.STATEMENT_CLASSES, subject="problem")
    # Of a probe that ran twice the last status in order of its name counts; a probe has one row as a rule.
    said = probed.groupBy("task_id", "probe").agg(F.max("status").alias("status")).groupBy("task_id").agg(F.map_from_entries(F.collect_list(F.struct("probe", "status"))).alias("probes"))
    both = rows.join(said, "task_id", "left")
    probes = F.coalesce("probes", F.create_map().cast("map<string,string>"))
    done = both.select("task_id", V.probe_checks(F.col("violations"), probes, F.col("has_gold")).alias("checks"))
    # A cheap proof is an observation about difficulty, no defect.
    return done.withColumn("state", V.health(F.filter("checks", lambda c: c["kind"] != "non_trivial")))


@dataclass
class Report:
    """The aggregates of a run, all of the size of participants, problems or reasons."""

    summary: DataFrame
    leaderboard: DataFrame
    by_problem: DataFrame
    reasons: DataFrame
    hacks: DataFrame


def report(graded: DataFrame, problems: DataFrame, participants: list[str]) -> Report:
    n_problems = problems.count()
    summary = graded.agg(
        F.count("*").alias("answers"),
        F.count_if("solved").alias("solved"),
        F.count_if(F.col("kernel") != "not_run").alias("kernel_checked"),
        F.coalesce(F.sum("build.compile_time_s"), F.lit(0.0)).alias("compile_time_s"),
        *[F.count_if(F.col("refused_at") == s).alias(f"refused_at_{s}") for s in dims.STAGES[1:6]],
    ).select(F.lit(n_problems).alias("problems"), F.lit(len(participants)).alias("participants"), "*")
    board = A.leaderboard(graded, "participant", "problem_id", F.col("solved"), n_problems, ~F.col("solved") & ~V.fault_kinds(F.col("faults"))[1])
    everyone = graded.sparkSession.createDataFrame([(p,) for p in participants], "participant string")
    idle = everyone.join(board, "participant", "left_anti").select(F.lit(None).cast("int").alias("rank"), "participant", F.lit(0).cast("bigint").alias("solved"), F.lit(0).cast("bigint").alias("attempted"), F.lit(0).cast("bigint").alias("rejected"), F.lit(n_problems).cast("bigint").alias("not_attempted"), F.lit(0).cast("bigint").alias("flagged"))
    refused = graded.withColumn("refusal", F.when(F.col("refused_at").isNotNull(), F.col("reason")))
    found = F.concat(F.transform(F.filter("faults", lambda f: f["fault"] == "reward_hacking"), lambda f: f["detail"]), F.coalesce("audit", F.array().cast("array<string>")))
    return Report(
        summary,
        board.unionByName(idle),
        A.problem_stats(problems, graded, "problem_id", F.col("solved"), F.col("refused_at"), F.col("kernel") != "not_run"),
        A.reasons(refused, "refusal").orderBy(F.desc("n"), "reason"),
        A.hack_histogram(graded.withColumn("found", found), "found"),
    )


def run(base: str, problems: DataFrame, submissions: Submissions, verifier: Verifier, policy: Policy | None = None, run_id: str | None = None) -> tuple[RunFolder, Report]:
    """Grade into a run folder, stage by stage; an error leaves the state ``failed`` and the stages done so far.

    Each stage is a table and its events are appended when it is there, so a run
    that stops shows which answers got how far.
    """
    folder = RunFolder(base, run_id)
    spark = problems.sparkSession
    try:
        folder.write_problems(problems)
        folder.write_inputs(submissions.answers)
        folder.write_screened(screened(submissions.answers, problems, policy))
        rows = folder.screened(spark)
        folder.append_events(interface_events(rows))
        folder.write_graded(judged(rows, verifier, policy))
        graded = folder.graded(spark)
        folder.append_events(build_events(graded))
        made = report(graded, problems, submissions.participants)
        for name in ("summary", "leaderboard", "by_problem", "reasons", "hacks"):
            folder.write_report(name.replace("_", "-"), getattr(made, name))
        folder.set_state("complete")
    except KeyboardInterrupt:
        folder.set_state("interrupted")
        raise
    except Exception:
        folder.set_state("failed")
        raise
    return folder, made


def check_source(module: str, answer_module: str, target_parameters: int, gold: list[str] | None = None) -> str:
    """The text that has a prover check an answer against the frozen target."""
    applied = "".join(f" ({g})" for g in gold or [])
    proof = "Submission.solution"
    goal = "_root_.Problem.Target" + applied
    if target_parameters and not gold:
        names = [f"v{i}" for i in range(target_parameters)]
        goal = f"∃ {' '.join(names)}, @_root_.Problem.Target {' '.join(names)}"
        proof = "⟨" + "_, " * target_parameters + proof + "⟩"
    return f"import {module}\nimport {answer_module}\n\ntheorem checked : {goal} :=\n  {proof}\n\n#print axioms checked\n"


def judge_prompt(informal: Column, formal: Column, rubric: str, gold: Column | None = None) -> Column:
    """The text a judge is asked about a statement; a blank gold formalization is left out."""
    part = lambda title, text: F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.concat(F.lit(f"{title}:\n"), text))
    parts = [F.lit(rubric), part("Informal statement", informal), part("Formal statement", formal)]
    return F.concat_ws("\n\n", *parts, *([part("Reference formalization", gold)] if gold is not None else []))


def unreadable(source: str) -> list[str]:
    """What of a file is no declaration the reader knows."""
    return parse_file(source).unparsed

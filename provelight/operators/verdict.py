"""Three-valued verdicts over prover, audit, judge and health records.

NULL means "not established" and is never turned into a pass or a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provelight import dims


def solved(faults: Column, build_status: Column, audit_ok: Column) -> Column:
    """A report without faults, a verified build and a clean audit; whatever is missing means not solved."""
    return F.coalesce((F.size(faults) == 0) & (build_status == "verified") & audit_ok, F.lit(False))


def fault_kinds(faults: Column) -> tuple[Column, Column, Column]:
    """(ok, honest_miss, incomplete_proof) of an interface report."""
    miss = ("solution_missing", "solution_unproved")
    honest = (F.size(faults) > 0) & F.forall(faults, lambda f: f["fault"].isin(*miss))
    return F.size(faults) == 0, honest, F.exists(faults, lambda f: f["fault"].isin("solution_unproved", "incomplete_proof"))


def refused_at(faults: Column, stages: Column, build_status: Column, build_failed_stage: Column, audit_ok: Column) -> Column:
    """The first check that refused: interface, a failed stage, the build, the axioms; NULL for none."""
    failed = F.filter(stages, lambda e: e["stage"].isin("kernel", "replay", "dependencies") & (e["status"] == "failed"))
    return (
        F.when(F.size(faults) > 0, "interface")
        .when(F.size(failed) > 0, F.get(failed, F.lit(0))["stage"])
        .when(build_status.isNull(), F.lit(None).cast("string"))
        .when(build_status != "verified", F.coalesce(build_failed_stage, F.lit("kernel")))
        .when(~audit_ok, "axioms")
    )


def kernel_status(stages: Column, build_status: Column) -> Column:
    """passed, failed or not_run: the last finished kernel event, else the build."""
    done = F.filter(stages, lambda e: (e["stage"] == "kernel") & (e["status"] != "running"))
    by_build = F.when(build_status.isNull() | build_status.isin("error", "skipped"), "not_run").when(build_status == "verified", "passed").otherwise("failed")
    return F.when(F.size(done) > 0, F.element_at(done, -1)["status"]).otherwise(by_build)


def stage_number(stage: Column) -> Column:
    """Place of a stage in the pipeline, from 0."""
    return F.array_position(F.array(*[F.lit(s) for s in dims.STAGES]), stage).cast("int") - 1


def stage_reached(stages: Column) -> Column:
    """The furthest stage that was not left out; running counts."""
    reached = F.transform(F.filter(stages, lambda e: e["status"] != "not_run"), lambda e: F.struct(stage_number(e["stage"]).alias("k"), e["stage"].alias("s")))
    return F.array_max(reached)["s"]


def latest_stages(events: DataFrame, keys: list[str], stage: str, ordinal: list[str]) -> DataFrame:
    """The last event of each key and stage; ordinals break ties from left to right.

    An aggregate with a map-side half: a key with a third of all events sends
    one row per task.
    """
    by = [*keys, stage]
    rest = [c for c in events.columns if c not in by]
    last = F.max_by(F.struct(*rest), F.struct(*ordinal)).alias("_last")
    return events.groupBy(*by).agg(last).select(*[c if c in by else F.col("_last")[c].alias(c) for c in events.columns])


def statement_status(checks: Column) -> Column:
    """unfaithful if any check failed, ok if any passed, else inconclusive; checks that are null say nothing."""
    known = lambda want: F.coalesce(F.exists(checks, lambda c: c["passed"].eqNullSafe(F.lit(want))), F.lit(False))
    return F.when(known(False), "unfaithful").when(known(True), "ok").otherwise("inconclusive")


def consensus(samples: Column) -> Column:
    """The majority label of an array of labels; a tie gives unsure, no label NULL."""
    labels = F.filter(samples, lambda s: s.isNotNull())
    counts = F.transform(F.array_distinct(labels), lambda x: F.struct(F.size(F.filter(labels, lambda y: y == x)).alias("n"), x.alias("label")))
    order = F.sort_array(counts, asc=False)
    tie = (F.size(order) > 1) & (F.get(order, F.lit(0))["n"] == F.get(order, F.lit(1))["n"])
    return F.when(F.size(labels) == 0, F.lit(None).cast("string")).when(tie, "unsure").otherwise(F.get(order, F.lit(0))["label"])


def consensus_rechecked(first: Column, again: Column) -> Column:
    """The majority of the first samples, and of the further ones too where a first one rejects."""
    more = F.when(F.array_contains(first, "unfaithful"), again)
    return consensus(F.concat(first, F.coalesce(more, F.array().cast("array<string>"))))


def agreeing_confidence(samples: Column, label: Column) -> Column:
    """Mean confidence of the samples (struct<label, confidence>) that agree with the outcome; NULL if none says."""
    same = F.filter(samples, lambda s: (s["label"] == label) & s["confidence"].isNotNull())
    total = F.aggregate(same, F.lit(0.0), lambda acc, s: acc + s["confidence"])
    return F.try_divide(total, F.size(same))


def statement_summary(df: DataFrame, status: Column, checks: str) -> DataFrame:
    """(status, n, failed_checks, assessed): statements by status; assessed ones have a check that is not NULL."""
    failed = F.size(F.filter(checks, lambda c: c["passed"].eqNullSafe(F.lit(False))))
    assessed = F.coalesce(F.exists(checks, lambda c: c["passed"].isNotNull()), F.lit(False))
    n_failed = F.when(F.col(checks).isNull(), 0).otherwise(failed)
    return df.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum(n_failed).alias("failed_checks"), F.count_if(assessed).alias("assessed"))


def usage_totals(df: DataFrame, usage: str) -> DataFrame:
    """One row with the sums of all usage records; a cost is NULL only if every cost is."""
    u = lambda f: F.col(f"{usage}.{f}")
    names = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "calls")
    return df.agg(*[F.coalesce(F.sum(u(n)), F.lit(0)).alias(n) for n in names], F.sum(u("estimated_cost_usd")).alias("estimated_cost_usd"))


def health(checks: Column) -> Column:
    """ungradeable, suspect, clean or unprobed, from checks with three-valued ``passed``; no checks are unprobed."""
    some = lambda cond: F.coalesce(F.exists(checks, cond), F.lit(False))
    failed = lambda c: c["passed"].eqNullSafe(F.lit(False))
    return (
        F.when(some(lambda c: failed(c) & c["fatal"]), "ungradeable")
        .when(some(failed), "suspect")
        .when(some(lambda c: c["passed"].isNotNull()), "clean")
        .otherwise("unprobed")
    )


CHECK = "struct<kind: string, passed: boolean, detail: string, fatal: boolean>"


def probe_checks(violations: Column, probes: Column, has_gold: Column) -> Column:
    """Health checks of a statement from its screening and the recorded outcomes of its probes.

    ``probes`` maps a probe's name to its status; one that is missing, an error or
    skipped leaves its question open (NULL).  A statement that does not elaborate
    is fatal and leaves the questions behind it open.  A cheap proof is an
    observation; a contradiction among hypotheses is fatal; cheap tactics that
    find neither establish nothing.
    """
    said = lambda name: F.try_element_at(probes, F.lit(name))
    ran = lambda name: said(name).isNotNull() & ~said(name).isin("error", "skipped")
    stuck = F.coalesce(ran("elaborates") & (said("elaborates") != "verified"), F.lit(False))
    closed = lambda name: ~stuck & ran(name) & (said(name) == "verified")

    def check(kind: str, passed: Column, detail: Column | str, fatal: Column | bool = False) -> Column:
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(kind).alias("kind"), passed.alias("passed"), as_col(detail).alias("detail"), as_col(fatal).alias("fatal")).cast(CHECK)

    none = F.lit(None).cast("boolean")
    whole = F.when(ran("elaborates"), said("elaborates") == "verified")
    checks = [
        check("assumes_nothing", F.size(violations) == 0, F.array_join(violations, "; "), F.size(violations) > 0),
        check("elaborates", whole, F.coalesce(said("elaborates"), F.lit("not probed")), stuck),
        check("non_trivial", F.when(closed("trivial"), False).otherwise(none), F.when(closed("trivial"), "a cheap tactic closes it").otherwise("not established")),
        check("non_vacuous", F.when(closed("vacuous"), False).otherwise(none), F.when(closed("vacuous"), "its hypotheses contradict one another").otherwise("not established"), F.coalesce(closed("vacuous"), F.lit(False))),
    ]
    gold = check("gold_equivalent", F.when(closed("gold_equivalent"), True).otherwise(none), F.when(closed("gold_equivalent"), "equivalent to the reference").otherwise("not established"))
    return F.concat(F.array(*checks), F.when(has_gold & ~stuck, F.array(gold)).otherwise(F.array().cast(f"array<{CHECK}>")))


def health_summary(df: DataFrame, checks: str) -> DataFrame:
    """(kind, n, passed, failed, open, fatal_failures) over all checks that are not null."""
    rows = df.select(F.explode(checks).alias("c")).where("c is not null").select("c.*")
    return rows.groupBy("kind").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("passed")).alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.count_if(F.col("passed").isNull()).alias("open"),
        F.count_if(~F.col("passed") & F.col("fatal")).alias("fatal_failures"),
    )


def draw(seed: str, text: Column) -> Column:
    """A stable number from 0 to 1: the first 8 bytes of sha256(seed + text) over 2^64."""
    high = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), text), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return high.cast("double") / F.lit(float(1 << 64))


def mock_verdict(source: Column, proof: Column, seed: str, pass_rate: float | None) -> Column:
    """struct<status, error_kind> of the marker-driven stand-in for a prover."""
    verdict = lambda s, k: F.struct(F.lit(s).alias("status"), F.lit(k).cast("string").alias("error_kind"))
    out = None
    for marker, status, kind in dims.MOCK_MARKERS:
        hit = source.contains(marker)
        out = F.when(hit, verdict(status, kind)) if out is None else out.when(hit, verdict(status, kind))
    if pass_rate is not None:
        out = out.when(draw(seed, proof) < pass_rate, verdict("verified", None))
    return out.otherwise(verdict("failed", "unsolved_goals"))


def mock_judgement(statement: Column, declared: Column, seed: str, faithful_rate: float | None) -> Column:
    """The label of the marker-driven stand-in for a judge; ``error`` where it is asked to fail."""
    said = F.lower(F.trim(F.coalesce(declared, F.lit(""))))
    out = F.when(said.isin("error", *dims.JUDGE_LABELS), said).when(statement.contains("JUDGE_ERROR"), "error")
    for name in ("unfaithful", "unsure", "faithful"):
        out = out.when(statement.contains(f"JUDGE_{name.upper()}"), name)
    if faithful_rate is not None:
        return out.otherwise(F.when(draw(seed, statement) < faithful_rate, "faithful").otherwise("unfaithful"))
    return out.otherwise("unsure")


def downgrade(status: Column, sound: Column) -> Column:
    """A verified result that is not sound is rejected."""
    return F.when((status == "verified") & ~F.coalesce(sound, F.lit(True)), "rejected").otherwise(status)

"""Aggregates over graded rows.

Inputs carry ``verified`` and ``scoreable`` flags where outcomes matter; a row
that is not scoreable counts as measured but neither as passed nor as failed.
Every aggregate is a hash aggregate with a map-side half; histograms over arrays
explode to (key, 1) rows that are combined before the shuffle, so a tactic in a
third of all rows costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provelight import dims


def outcome(status: Column) -> tuple[Column, Column]:
    """(verified, scoreable) of a status; null is neither."""
    return F.coalesce(status == "verified", F.lit(False)), F.coalesce(status.isin(*dims.SCOREABLE), F.lit(False))


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def tactic_frequency(df: DataFrame, tactics: str, verified: Column, scoreable: Column) -> DataFrame:
    """(tactic, uses, proofs_using, in_verified, in_failed, success_rate, suspect) per tactic."""
    rows = df.select(F.col(tactics).alias("t"), (verified & scoreable).alias("v"), (~verified & scoreable).alias("f"))
    each = rows.select("v", "f", F.explode(F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("tactic"), F.size(F.filter("t", lambda y: y == x)).alias("n")))).alias("x"))
    out = each.groupBy(F.col("x.tactic").alias("tactic")).agg(
        F.sum("x.n").alias("uses"),
        F.count("*").alias("proofs_using"),
        F.count_if("v").alias("in_verified"),
        F.count_if("f").alias("in_failed"),
    )
    return out.withColumn("success_rate", _rate(F.col("in_verified"), F.col("in_verified") + F.col("in_failed"))).withColumn(
        "suspect", F.col("tactic").isin(*dims.SUSPECT_TACTICS)
    )


def tactic_totals(df: DataFrame, tactics: str) -> DataFrame:
    """One row: proofs measured, without tactics, invocations, mean distinct and mean invocations per proof with tactics counted."""
    n, d = F.size(tactics), F.size(F.array_distinct(tactics))
    return df.where(F.col(tactics).isNotNull()).agg(
        F.count("*").alias("proofs_measured"),
        F.count_if(n == 0).alias("proofs_without_tactics"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total_invocations"),
        F.coalesce(F.avg(d), F.lit(0.0)).alias("mean_distinct"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("mean_invocations"),
    )


def edge_tactics(df: DataFrame, tactics: str) -> DataFrame:
    """(tactic, as_first, as_last): how often each opens and closes a proof."""
    ends = F.array(
        F.struct(F.get(F.col(tactics), F.lit(0)).alias("tactic"), F.lit(1).alias("a"), F.lit(0).alias("b")),
        F.struct(F.element_at(tactics, -1).alias("tactic"), F.lit(0).alias("a"), F.lit(1).alias("b")),
    )
    rows = df.where(F.size(tactics) > 0).select(F.explode(ends).alias("e"))
    return rows.groupBy(F.col("e.tactic").alias("tactic")).agg(F.sum("e.a").alias("as_first"), F.sum("e.b").alias("as_last"))


def transitions(df: DataFrame, tactics: str, verified: Column) -> DataFrame:
    """(pair, n, n_verified, success_rate) of tactics that follow one another."""
    t = F.col(tactics)
    n = F.size(t)
    pairs = F.when(n > 1, F.zip_with(F.slice(t, 1, F.greatest(n - 1, F.lit(0))), F.slice(t, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("->"), b)))
    rows = df.select(F.explode(pairs).alias("pair"), verified.alias("v"))
    out = rows.groupBy("pair").agg(F.count("*").alias("n"), F.count_if("v").alias("n_verified"))
    return out.withColumn("success_rate", _rate(F.col("n_verified"), F.col("n")))


def tactic_positions(df: DataFrame, tactics: str) -> DataFrame:
    """(tactic, mean_position, n): where in a proof a tactic stands, 0 first and 1 last."""
    rows = df.select(F.size(tactics).alias("n"), F.posexplode(tactics).alias("pos", "tactic"))
    return rows.groupBy("tactic").agg(F.avg(F.col("pos") / F.greatest(F.lit(1), F.col("n") - 1)).alias("mean_position"), F.count("*").alias("n"))


def top(df: DataFrame, count: str, name: str, limit: int) -> DataFrame:
    """The ``limit`` most frequent names; equal counts in the order of the names."""
    return df.orderBy(F.desc(count), F.asc(name)).limit(limit)


def ranked(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """(key, n) by falling count; equal counts in the order of their first ordinal."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(ordinal).alias("first_seen")).orderBy(F.desc("n"), "first_seen")


def distribution(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, n, mean, median, stdev, min, p25, p75, p90, max, total); percentiles interpolate linearly."""
    p = F.percentile(value, F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75, 0.9)]))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = df.groupBy(*groups).agg(
        F.count(value).alias("n"),
        zero(F.avg(value)).alias("mean"),
        p.alias("_p"),
        zero(F.stddev_pop(value)).alias("stdev"),
        zero(F.min(value).cast("double")).alias("min"),
        zero(F.max(value).cast("double")).alias("max"),
        zero(F.sum(value).cast("double")).alias("total"),
    )
    at = lambda k: zero(F.get("_p", F.lit(k)))
    return out.select(*groups, "n", "mean", at(1).alias("median"), "stdev", "min", at(0).alias("p25"), at(2).alias("p75"), at(3).alias("p90"), "max", "total")


def long_form(df: DataFrame, metrics: dict[str, Column], keep: Sequence[str | Column]) -> DataFrame:
    """(keep..., ordinal, metric, value): one row per metric, in the given order."""
    items = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("metric"), c.cast("double").alias("value")) for i, (n, c) in enumerate(metrics.items())])
    return df.select(*keep, F.explode(items).alias("m")).select("*", "m.*").drop("m")


def structure_stats(df: DataFrame, metrics: dict[str, Column], verified: Column, scoreable: Column) -> DataFrame:
    """Distribution of each metric over all rows and over the verified and the failed ones."""
    rows = long_form(df, metrics, [verified.alias("v"), scoreable.alias("s")]).where("value is not null")
    cohorts = F.array_compact(F.array(F.lit("pooled"), F.when(F.col("s") & F.col("v"), "verified"), F.when(F.col("s") & ~F.col("v"), "failed")))
    return distribution(rows.select("metric", "value", F.explode(cohorts).alias("cohort")), ["metric", "cohort"], "value")


def correlations(df: DataFrame, metrics: dict[str, Column], verified: Column, scoreable: Column, least: float = 0.1) -> DataFrame:
    """(metric, n, r, mean_verified, mean_failed, strength, direction) of metrics that go with the outcome.

    Point-biserial r over scoreable rows; none below three rows or where either
    side is constant.  Sorted by |r|, ties in the order of the metrics.
    """
    rows = long_form(df.where(scoreable), metrics, [verified.cast("double").alias("y")]).where("value is not null")
    out = rows.groupBy("ordinal", "metric").agg(
        F.count("*").alias("n"),
        F.covar_pop("value", "y").alias("_c"),
        (F.stddev_pop("value") * F.stddev_pop("y")).alias("_s"),
        F.avg(F.when(F.col("y") == 1, F.col("value"))).alias("mean_verified"),
        F.avg(F.when(F.col("y") == 0, F.col("value"))).alias("mean_failed"),
    )
    r = F.when(F.col("n") >= 3, F.try_divide("_c", "_s"))
    size = F.abs("r")
    strength = F.when(size >= 0.5, "strong").when(size >= 0.3, "moderate").when(size >= 0.1, "weak").otherwise("negligible")
    return (
        out.withColumn("r", r)
        .where(F.abs("r") >= least)
        .withColumn("strength", strength)
        .withColumn("direction", F.when(F.col("r") > 0, "positive").when(F.col("r") < 0, "negative").otherwise("none"))
        .orderBy(F.desc(F.abs("r")), "ordinal")
        .select("metric", "n", "r", "mean_verified", "mean_failed", "strength", "direction")
    )


def with_attribution(df: DataFrame, mode: str) -> DataFrame:
    """Adds ``attribution``; a mode that is not known becomes ``unclassified`` first."""
    known = F.create_map(*[F.lit(x) for pair in dims.FAILURE_MODES.items() for x in pair])
    safe = F.when(F.col(mode).isNull() | F.col(mode).isin(*dims.FAILURE_MODES), F.col(mode)).otherwise("unclassified")
    return df.withColumn(mode, safe).withColumn("attribution", F.try_element_at(known, F.col(mode)))


def failure_stats(df: DataFrame, mode: str, model: str) -> DataFrame:
    """(kind, name, model, n): failures by mode, by attribution, and by model and mode.

    One pass over the rows and one aggregate for the three histograms.
    """
    rows = with_attribution(df.where(F.col(mode).isNotNull()), mode)
    none = F.lit(None).cast("string")
    row = lambda kind, name, m: F.struct(F.lit(kind).alias("kind"), name.alias("name"), m.alias("model"))
    items = F.array_compact(
        F.array(
            row("mode", F.col(mode), none),
            row("attribution", F.col("attribution"), none),
            F.when(F.col(model).isNotNull(), row("model_mode", F.col(mode), F.col(model))),
        )
    )
    return rows.select(F.explode(items).alias("x")).groupBy("x.kind", "x.name", "x.model").agg(F.count("*").alias("n"))


def first_error_position(df: DataFrame, diagnostics: str, lines: Column) -> DataFrame:
    """One row: mean of the first error line over the lines of the proof, between 0 and 1; lines of 0 do not count."""
    at = F.get(F.filter(diagnostics, lambda d: d.isNotNull() & (d["severity"] == "error") & (d["line"] > 0)), F.lit(0))["line"]
    share = F.when((at > 0) & (lines > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), at / lines)))
    return df.agg(F.avg(share).alias("mean_first_error_position"), F.count(share).alias("n"))


def success_stats(df: DataFrame, mode: str, model: str) -> DataFrame:
    """(model, successes, substantive_fraction, automation_fraction) per model and, with NULL model, over all."""
    rows = df.where(F.col(mode).isNotNull())
    solid = [m for m, yes in dims.SUCCESS_MODES.items() if yes]
    agg = [
        F.count("*").alias("successes"),
        F.avg(F.col(mode).isin(*solid).cast("double")).alias("substantive_fraction"),
        F.avg((F.col(mode).isin("one_liner_automation", "brute_force_decide")).cast("double")).alias("automation_fraction"),
    ]
    rows = rows.select(F.col(model).alias("model"), mode)
    return rows.groupingSets([["model"], []], "model").agg(F.grouping("model").alias("over_all"), *agg)


def sample_duplication(df: DataFrame, task: str, text: Column) -> DataFrame:
    """One row: how far the samples of a task repeat one another.

    Tasks with one sample are left out.  Texts are compared without white space
    at their ends, by 128 bits of hash; null texts count as empty.
    """
    text = F.coalesce(text, F.lit(""))
    bare = df.select(F.col(task).alias("task"), text.alias("_text"))
    rows = bare.select("task", F.struct(F.xxhash64("_text").alias("a"), F.xxhash64(F.lit(3), "_text").alias("b")).alias("t"))
    # Two steps, so that a task with a third of all rows is pre-aggregated by text.
    by_text = rows.groupBy("task", "t").agg(F.count("*").alias("n"))
    by_task = by_text.groupBy("task").agg(F.sum("n").alias("n"), F.count("*").alias("d")).where("n > 1")
    return by_task.agg(
        F.count("*").alias("tasks_with_multiple_samples"),
        F.count_if(F.col("d") < F.col("n")).alias("tasks_with_duplicates"),
        F.count_if(F.col("d") == 1).alias("tasks_all_identical"),
        F.coalesce(F.avg(1 - F.col("d") / F.col("n")), F.lit(0.0)).alias("mean_duplicate_fraction"),
    ).withColumn("undermines_pass_at_k", (F.col("mean_duplicate_fraction") >= 0.25) | (F.col("tasks_all_identical") > 0))


def leaderboard(df: DataFrame, participant: str, problem: str, solved: Column, total_problems: int | None = None, flagged: Column | None = None) -> DataFrame:
    """(rank, participant, solved, attempted, rejected, not_attempted) by falling number of solved problems.

    With ``flagged`` also how many answers of a participant are worth a look.

    Ties: fewer attempts first, then the name.  The ranking sorts participants,
    not answers.
    """
    per = df.groupBy(F.col(participant).alias("participant")).agg(
        F.count_if(solved).alias("solved"), F.count("*").alias("attempted"), F.countDistinct(problem).alias("_tried"),
        *([F.count_if(flagged).alias("flagged")] if flagged is not None else []),
    )
    rank = F.row_number().over(Window.orderBy(F.desc("solved"), "attempted", "participant"))
    missing = F.lit(None).cast("bigint") if total_problems is None else F.greatest(F.lit(0), F.lit(total_problems) - F.col("_tried"))
    return per.select(rank.alias("rank"), "participant", "solved", "attempted", (F.col("attempted") - F.col("solved")).alias("rejected"), missing.alias("not_attempted"), *(["flagged"] if flagged is not None else []))


def problem_stats(problems: DataFrame, df: DataFrame, problem: str, solved: Column, failed_at: Column, compiled: Column) -> DataFrame:
    """Per problem: attempts, solved, refusals by stage; problems nobody tried and unlisted ones are kept."""
    agg = df.groupBy(problem).agg(
        F.count("*").alias("attempted"),
        F.count_if(solved).alias("solved"),
        *[F.count_if(failed_at == s).alias(f"refused_at_{s}") for s in ("interface", "kernel", "replay", "dependencies", "axioms")],
        F.count_if(~compiled).alias("not_compiled"),
    )
    out = problems.select(problem).distinct().join(agg, problem, "full")
    out = out.fillna(0, [c for c in out.columns if c != problem])
    return out.withColumn("solve_rate", _rate(F.col("solved"), F.col("attempted")))


def reasons(df: DataFrame, reason: str) -> DataFrame:
    """(reason, n): refusal reasons up to their first parenthesis, at most 90 characters."""
    short = F.substring(F.trim(F.substring_index(reason, "(", 1)), 1, 90)
    return df.where(F.col(reason).isNotNull()).groupBy(short.alias("reason")).agg(F.count("*").alias("n"))


def hack_histogram(df: DataFrame, violations: str) -> DataFrame:
    """(class, rule, n) over labelled violations; placeholders and unlabelled ones are left out."""
    from provelight.operators.screen import label_parts

    each = df.select(F.explode(violations).alias("v")).select(F.explode(F.split("v", "; ")).alias("v"))
    hack, rule = label_parts(F.col("v"))
    rows = each.select(hack.alias("class"), rule.alias("rule")).where("rule is not null and class <> 'placeholder'")
    return rows.groupBy("class", "rule").agg(F.count("*").alias("n"))


def index_attempts(df: DataFrame, task: str, ordinal: str, value: Column, width: int = 10_000) -> DataFrame:
    """(task, chunk, attempts): the attempts of each task in their order, ``width`` ordinals a chunk.

    Ordinals are unique bigints, so no chunk holds more than ``width`` attempts,
    however many a task has; chunks of a task are in order of ``chunk``.
    """
    chunk = F.floor(F.col(ordinal) / width).cast("bigint").alias("chunk")
    both = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), value.alias("v"))))
    return df.groupBy(task, chunk).agg(F.transform(both, lambda x: x["v"]).alias("attempts"))


def duplicate_names(declarations: DataFrame, file: str, name: str) -> DataFrame:
    """(file, name, n) of names a file declares more than once; nameless declarations do not count."""
    return declarations.where(F.col(name) != "").groupBy(file, name).agg(F.count("*").alias("n")).where("n > 1")

"""Ordered rules that name what went wrong, or what kind of proof succeeded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provelight import dims
from provelight.functions.text import all_of, is_blank, java, lines_of, matches, open_brackets, rstrip, strip


def first_match(text: Column, rules: tuple[tuple[str, str], ...], otherwise: str | None) -> Column:
    """The name of the first rule whose pattern is in the text, letter case free."""
    out: Column | None = None
    for pattern, name in rules:
        hit = matches(text, pattern, ignore_case=True)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def error_kind(message: Column) -> Column:
    """The kind of a prover message."""
    return first_match(message, dims.ERROR_KINDS, "unknown")


def looks_truncated(proof: Column) -> Column:
    """More opening than closing brackets, or an ending that announces more."""
    text = rstrip(proof)
    # The ending is at most a keyword of six letters and what stands before it.
    ending = F.right(text, F.lit(16))
    return (text != "") & ((open_brackets(text, dims.OPENERS, dims.CLOSERS) > 0) | matches(ending, dims.TRUNCATED_TAIL))


def error_messages(diagnostics: Column) -> Column:
    """All messages of severity error, joined by line feeds."""
    errors = F.filter(diagnostics, lambda d: d.isNotNull() & (d["severity"] == "error"))
    return F.coalesce(F.array_join(F.transform(errors, lambda d: d["message"]), "\n"), F.lit(""))


def failure_mode(status: Column, kind: Column, messages: Column, proof: Column, sound: Column) -> Column:
    """What went wrong with an attempt; NULL for a clean success.

    ``messages`` should be a column made by ``error_messages`` in a projection
    of its own: the rules below look at it up to 37 times.
    """
    return failure_mode_of(status, kind, messages, is_blank(F.coalesce(proof, F.lit(""))), looks_truncated(proof), sound)


def failure_mode_of(status: Column, kind: Column, messages: Column, blank: Column, truncated: Column, sound: Column) -> Column:
    """``failure_mode`` from what it needs of the proof: whether that is blank, whether it looks truncated."""
    fallback = F.create_map(*[F.lit(x) for pair in dims.FAILURE_FALLBACK.items() for x in pair])
    cut = matches(messages, "unexpected end of input", True) | (
        truncated & ((messages == "") | matches(messages, "unexpected token|expected", True))
    )
    by_kind = F.coalesce(F.try_element_at(fallback, F.coalesce(kind, F.lit("unknown"))), F.lit("unclassified"))
    return (
        F.when(status == "verified", F.lit(None).cast("string"))
        .when((status == "rejected") | ~F.coalesce(sound, F.lit(True)), "reward_hacking")
        .when(status == "timeout", "wall_clock_timeout")
        .when(status == "skipped", "language_mismatch")
        .when(kind.eqNullSafe("toolchain"), "toolchain_error")
        .when(kind.eqNullSafe("harness") | (status == "error"), "harness_error")
        .when(blank, "empty_proof")
        .when(cut, "truncated_output")
        .otherwise(F.coalesce(first_match(messages, dims.FAILURE_PATTERNS, None), by_kind))
    )


def success_mode(tactics: Column, named_steps: Column, term_mode: Column, auxiliary: Column | int = 0, calc_blocks: Column | int = 0) -> Column:
    """What kind of proof succeeded, by its most demanding feature; nulls count as 0 and false."""
    as_int = lambda c: F.coalesce(F.lit(c) if isinstance(c, int) else c, F.lit(0))
    names = lambda values: F.array(*[F.lit(v) for v in values])
    used = F.coalesce(tactics, F.array().cast("array<string>"))
    n = F.size(used)
    only = lambda values: F.size(F.array_except(used, names(values))) == 0
    return (
        F.when(as_int(auxiliary) > 0, "auxiliary_lemmas")
        .when(F.arrays_overlap(used, names(dims.INDUCTION_TACTICS)), "induction")
        .when(as_int(calc_blocks) > 0, "calc_chain")
        .when(F.arrays_overlap(used, names(dims.CASE_TACTICS)), "case_analysis")
        .when(as_int(named_steps) > 0, "structured_with_steps")
        .when(F.coalesce(term_mode, F.lit(False)), "term_mode")
        .when(n == 0, "unclassified")
        .when((n == 1) & only(dims.DECISION_TACTICS), "brute_force_decide")
        .when(n == 1, "one_liner_automation")
        .when(only(dims.DECISION_TACTICS), "brute_force_decide")
        .when((n <= 2) & only(dims.AUTOMATION_TACTICS), "one_liner_automation")
        .when(n <= 5, "short_tactic_chain")
        .otherwise("long_tactic_chain")
    )


def invented_names(diagnostics: Column) -> Column:
    """Names the prover says do not exist, in order, repeats kept."""
    messages = F.transform(F.filter(diagnostics, lambda d: d.isNotNull()), lambda d: F.coalesce(d["message"], F.lit("")))
    return F.flatten(F.transform(messages, lambda m: all_of(m, dims.INVENTED_NAME, 1, ignore_case=True)))


def printed_axioms(log: Column, name: Column) -> Column:
    """The axioms a listing names for a declaration: [] for none, NULL unless exactly one listing is there."""
    p = F.lit(java(dims.AXIOM_LINE))
    names, lists = F.regexp_extract_all(log, p, F.lit(1)), F.regexp_extract_all(log, p, F.lit(2))
    own = F.filter(F.arrays_zip(names.alias("n"), lists.alias("a")), lambda x: x["n"] == name)
    listed = F.filter(F.transform(F.split(own[0]["a"], ","), strip), lambda a: a != "")
    return F.when(F.size(own) == 1, listed)


def parse_prover_log(df: DataFrame, keys: list[str], log: str) -> DataFrame:
    """(keys, ordinal, severity, message, line, column, kind) of every message of a prover log.

    A message line opens a diagnostic, the lines below continue it; lines before
    the first are dropped.  Kinds are set for errors only, from the whole message
    where the first line has none.  Keys must identify a row.
    """
    pattern = java(dims.PROVER_LINE)
    lines = df.select(*keys, F.posexplode(lines_of(F.col(log))).alias("_pos", "_raw")).withColumn("_line", strip(F.col("_raw")))
    opens = F.col("_line").rlike(pattern)
    by = Window.partitionBy(*keys).orderBy("_pos")
    part = lambda k: F.regexp_extract("_line", pattern, k)
    grouped = lines.withColumn("_opens", opens).withColumn("ordinal", F.sum(F.col("_opens").cast("int")).over(by)).where("ordinal > 0")
    head = lambda c: F.max(F.when(F.col("_opens"), c))
    below = F.array_sort(F.collect_list(F.when(~F.col("_opens"), F.struct("_pos", "_raw"))))
    joined = rstrip(F.array_join(F.transform(F.col("_below"), lambda x: x["_raw"]), "\n"))
    found = grouped.groupBy(*keys, "ordinal").agg(
        head(part(4)).alias("severity"),
        head(strip(part(5))).alias("_first"),
        head(part(2).try_cast("int")).alias("line"),
        head(part(3).try_cast("int")).alias("column"),
        below.alias("_below"),
    )
    message = F.when(joined == "", F.col("_first")).otherwise(strip(F.concat("_first", F.lit("\n"), joined)))
    first = error_kind(F.col("_first"))
    kind = F.when(F.col("severity") == "error", F.when(first != "unknown", first).otherwise(error_kind(F.col("message"))))
    return found.withColumn("message", message).select(*keys, "ordinal", "severity", "message", "line", "column", kind.alias("kind"))


def remote_kind(message: Column, severity: Column) -> tuple[Column, Column]:
    """Severity and kind of a message from a remote prover; unknown severities count as errors."""
    alias = F.create_map(*[F.lit(x) for pair in dims.SEVERITY_ALIASES.items() for x in pair])
    known = F.coalesce(F.try_element_at(alias, F.lower(severity)), F.lit("error"))
    return known, F.when(known == "error", error_kind(message))

"""Screening of sources for ways to be accepted without proving anything."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provelight import dims
from provelight.functions.lean import foreign_attributes, inherited_column, parse_column, strip_comments_column, top_level_arguments
from provelight.functions.text import all_of, matches, strip

def label(hack_class: str | Column, rule: str | Column, message: str | Column) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.concat(F.lit("["), as_col(hack_class), F.lit(":"), as_col(rule), F.lit("] "), as_col(message))


def label_parts(violation: Column) -> tuple[Column, Column]:
    """(class, rule) of a labelled violation, NULL where it carries no label."""
    part = lambda k: F.nullif(F.regexp_extract(violation, dims.LABEL, k), F.lit(""))
    return part(1), part(2)


def normal_statement(stripped: Column) -> Column:
    """A statement without line breaks, proof seam and trailing colons."""
    one = strip(F.regexp_replace(stripped, r"(?U)\s+", " "))
    return F.regexp_replace(strip(F.regexp_replace(one, r":=\s*(by\b.*)?$", "")), r"[:= ]+$", "")


def statement_names(stripped: Column) -> Column:
    """Names a statement depends on, without its own name and common ones."""
    rest = F.regexp_replace(stripped, dims.STATEMENT_HEAD, " ")
    names = F.array_distinct(all_of(rest, dims.STATEMENT_NAME))
    return F.filter(names, lambda n: ~n.isin(*dims.COMMON_IDENTIFIERS) & (F.length(n) > 1))


def homoglyph(body: Column) -> Column:
    """The first identifier that mixes ASCII letters with Cyrillic lookalikes."""
    mixed = lambda t: t.rlike(f"[{dims.CYRILLIC_LOOKALIKES}]") & t.rlike("[A-Za-z]")
    first = F.get(F.filter(F.regexp_extract_all(body, F.lit(dims.GLYPH_WORD), F.lit(0)), mixed), F.lit(0))
    return F.when(body.rlike(f"[{dims.CYRILLIC_LOOKALIKES}]"), first)


def add_violations(
    df: DataFrame,
    source: str,
    language: Column,
    required: Column | None = None,
    classes: Sequence[str] = dims.HACK_CLASSES,
    allowed_imports: Sequence[str] | None = dims.ALLOWED_IMPORTS,
    subject: str = "proof",
    baseline: Column | None = None,
) -> DataFrame:
    """Adds ``violations``, the labelled findings about a source in rule order.

    Each rule is tried only where its language fits and one of its literals
    occurs, so an honest text costs a few substring searches.  ``required`` is
    the statement the source must contain, NULL where that cannot be altered.
    What a source shares with its ``baseline`` (the problem file) is no finding of
    a rule: every match must be there as often, compared by whole logical lines.
    Null sources have no violations.
    """
    work = df.withColumn("_body", strip_comments_column(F.coalesce(F.col(source), F.lit("")), language))
    work = work.withColumn("_low", F.lower("_body"))
    body, low = F.col("_body"), F.col("_low")
    found: list[Column] = []
    for rule, hack, languages, pattern, literals in dims.SCREEN_RULES:
        if hack not in classes:
            continue
        near = F.lit(False)
        for literal in literals:
            near = near | low.contains(literal)
        found.append(F.when(language.isin(*languages) & near & matches(body, pattern), label(hack, rule, f"{subject} matches this rule")))
    arrays = [F.array(*found)] if found else []
    if baseline is not None:
        work = work.withColumn("_base", strip_comments_column(F.coalesce(baseline, F.lit("")), language))
        work = work.withColumn("_kept", inherited_column(body, F.nullif("_base", F.lit(""))))
        arrays = [F.filter(F.array(*found), lambda v: ~F.array_contains("_kept", label_parts(v)[1]))]
    if allowed_imports is not None and "new_axiom" in classes:
        odd = F.filter(all_of(body, dims.IMPORT, 1), lambda m: ~F.substring_index(m, ".", 1).isin(*allowed_imports))
        notes = F.transform(odd, lambda m: label("new_axiom", "lean.unknown_import", F.concat(F.lit(f"{subject} imports "), m)))
        arrays.append(F.when((language == "lean4") & low.contains("import"), notes).otherwise(F.array().cast("array<string>")))
    if "homoglyph" in classes:
        token = homoglyph(body)
        arrays.append(F.array(F.when(token.isNotNull(), label("homoglyph", "generic.homoglyph_identifier", F.concat(F.lit("identifier "), token)))))
    if required is not None and "statement_tampering" in classes:
        work = work.withColumn("_req", strip_comments_column(F.coalesce(required, F.lit("")), language))
        wanted, asked = normal_statement(F.col("_req")), required.isNotNull()
        missing = asked & (wanted != "") & ~normal_statement(body).contains(wanted)
        arrays.append(F.array(F.when(missing, label("statement_tampering", "generic.statement_altered", f"{subject} lacks the required statement"))))
        lean = language.isin("lean4", "lean3")
        work = work.withColumn("_names", statement_names(F.col("_req")))
        names = F.col("_names")
        shadow = F.array_sort(F.array_intersect(F.when(lean, all_of(body, dims.DECLARED_NAME, 1)).otherwise(F.array().cast("array<string>")), names))
        note = F.concat(F.lit(f"{subject} redefines "), F.array_join(F.slice(shadow, 1, 4), ", "))
        arrays.append(F.array(F.when(asked & (F.size(shadow) > 0), label("definition_shadowing", "lean.redefines_statement_term", note))))
        arrays.append(F.array(F.when(asked & matches(body, dims.NOTATION), label("definition_shadowing", "lean.notation_redefinition", f"{subject} introduces notation"))))
        bare = F.array_union(F.transform(names, lambda n: F.substring_index(n, ".", -1)), names)
        opened = F.filter(all_of(body, dims.OPEN, 1), lambda o: ~matches(o, r"hiding\s+([^\n]+)"))
        spaces = F.flatten(F.transform(opened, lambda o: all_of(F.substring_index(o, " in ", 1), r"[A-Za-z_][A-Za-z0-9_.']*")))
        hits = F.filter(spaces, lambda s: ~s.isin("hiding", "renaming", "in") & F.array_contains(bare, F.substring_index(s, ".", -1)))
        note_ = lambda s: label("definition_shadowing", "lean.open_shadows_statement", F.concat(F.lit(f"{subject} opens "), s))
        arrays.append(F.when(asked, F.transform(hits, note_)).otherwise(F.array().cast("array<string>")))
    return work.withColumn("violations", F.filter(F.concat(*arrays), lambda v: v.isNotNull())).drop("_body", "_low", "_req", "_names", "_base", "_kept")


def multiset_excess(theirs: DataFrame, base: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, item, extra) of items that occur more often than in the baseline."""
    count = lambda df, name: df.groupBy(*keys, item).agg(F.count("*").alias(name))
    both = count(theirs, "_n").join(count(base, "_b"), [*keys, item], "left")
    extra = F.col("_n") - F.coalesce("_b", F.lit(0))
    return both.select(*keys, item, extra.alias("extra")).where("extra > 0")


def axiom_violations(axioms: Column, allowed: Sequence[str] = dims.ALLOWED_AXIOMS) -> Column:
    """Labelled findings about a list of axioms; a NULL list means the audit did not run."""
    odd = F.array_sort(F.array_except(axioms, F.array(*[F.lit(a) for a in allowed])))
    each = lambda a: (
        F.when(a == "sorryAx", label("placeholder", "kernel.sorry_ax", "depends on sorryAx"))
        .when(a.isin(*dims.COMPILER_AXIOMS), label("kernel_bypass", "kernel.compiler_trust", F.concat(F.lit("depends on "), a)))
        .otherwise(label("new_axiom", "kernel.nonstandard_axiom", F.concat(F.lit("depends on "), a)))
    )
    missing = F.array(label("placeholder", "kernel.audit_missing", "no axiom listing"))
    return F.when(axioms.isNull(), missing).otherwise(F.transform(odd, each))


def foreign_imports(modules: Column, allowed: Sequence[str], own: Column) -> Column:
    """Modules that are neither the problem's own nor under an allowed prefix."""
    fine = lambda m: F.reduce(
        F.array(*[F.lit(a) for a in allowed]), F.lit(False), lambda acc, a: acc | (m == a) | m.startswith(F.concat(a, F.lit(".")))
    )
    return F.filter(modules, lambda m: (m != own) & ~fine(m)) if allowed else F.filter(modules, lambda m: m != own)


def add_interface_report(df: DataFrame, source: str, module: Column, wants_value: Column, allowed_imports: Sequence[str] | None = None, allow_instances: bool = True) -> DataFrame:
    """Adds ``faults`` array<struct<fault, detail>>, ``submitted_arguments``, ``helper_count`` and ``solution_body`` of an answer file.

    Faults come in one fixed order: what cannot be read, the solution missing or
    unproved, namespaces, binders, placeholders and hacks, extensions, imports,
    instances where the policy forbids them.
    """
    @F.pandas_udf("array<string>")
    def arguments(signature: pd.Series) -> pd.Series:
        marker = "Problem.Target"
        return pd.Series([[] if s is None or marker not in s else top_level_arguments(s[s.find(marker) + len(marker) :].strip()) for s in signature])

    @F.pandas_udf("int")
    def foreign(text: pd.Series) -> pd.Series:
        return pd.Series([foreign_attributes(t) if t else 0 for t in text])

    work = df.withColumn("_file", parse_column(F.coalesce(F.col(source), F.lit(""))))
    work = add_violations(work, source, F.lit("lean4"), None, dims.ANSWER_CLASSES, None, "answer").withColumnRenamed("violations", "_violations")
    decls = F.col("_file.declarations")
    work = work.withColumn("_solution", F.get(F.filter(decls, lambda d: d["qualified_name"] == "Submission.solution"), F.lit(0)))
    sol = F.col("_solution")
    inside = lambda ns, root: (ns == root) | ns.startswith(root + ".")
    parents = lambda d: F.slice(F.split(d["qualified_name"], r"\."), 1, F.greatest(F.lit(0), F.size(F.split(d["qualified_name"], r"\.")) - 1))
    into = F.filter(decls, lambda d: F.array_contains(F.split(d["namespace"], r"\."), "Problem") | F.array_contains(parents(d), "Problem"))
    out = F.filter(decls, lambda d: (d["name"] != "") & ~inside(d["namespace"], "Submission") & ~inside(d["namespace"], "Problem"))
    names = lambda ds: F.array_join(F.slice(F.transform(ds, lambda d: d["qualified_name"]), 1, 3), ", ")
    is_hole = lambda v: v.startswith("[placeholder:")
    holes = F.filter("_violations", is_hole)
    hacks = F.filter("_violations", lambda v: ~is_hole(v))
    unproved = F.coalesce(sol["is_unproved"], F.lit(False))
    no_strings = F.regexp_replace(strip_comments_column(F.coalesce(F.col(source), F.lit(""))), r'"(?:\\.|[^"\\])*"', '""')
    fault = lambda when, name, detail: F.when(when, F.struct(F.lit(name).alias("fault"), detail.alias("detail")))
    signature = strip(F.coalesce(sol["signature"], F.lit("")))
    faults = [
        fault(F.size("_file.unparsed") > 0, "unparsed", F.substring(F.get("_file.unparsed", F.lit(0)), 1, 80)),
        fault(sol.isNull(), "solution_missing", F.when(wants_value, "Submission.solution : Problem.Target <value>").otherwise("Submission.solution : Problem.Target")),
        fault(unproved, "solution_unproved", F.lit("Submission.solution is left open")),
        fault(F.size(into) > 0, "problem_namespace_reused", names(into)),
        fault(F.size(out) > 0, "declaration_outside_namespace", names(out)),
        fault((signature != "") & ~signature.startswith(":"), "solution_binders", signature),
        fault((F.size(holes) > 0) & ~unproved, "incomplete_proof", F.array_join(holes, "; ")),
        fault(F.size(hacks) > 0, "reward_hacking", F.array_join(hacks, "; ")),
        fault(matches(no_strings, dims.EXTENSION), "syntax_extension", F.lit("answer extends the syntax")),
    ]
    faults_ = F.concat(
        F.filter(F.array(*faults), lambda f: f.isNotNull()),
        F.array_repeat(F.struct(F.lit("imported_attribute").alias("fault"), F.lit("attribute on a foreign declaration").alias("detail")), foreign(F.col(source))),
    )
    if allowed_imports is not None:
        bad = foreign_imports(F.col("_file.imports"), allowed_imports, module)
        faults_ = F.concat(faults_, F.filter(F.array(fault(F.size(bad) > 0, "import_not_allowed", F.array_join(F.slice(bad, 1, 4), ", "))), lambda f: f.isNotNull()))
    if not allow_instances:
        own = F.exists(decls, lambda d: d["kind"] == "instance")
        forbidden = fault(own, "instance_not_allowed", F.lit("the policy forbids global instances"))
        faults_ = F.concat(faults_, F.filter(F.array(forbidden), lambda f: f.isNotNull()))
    return (
        work.withColumn("faults", faults_)
        .withColumn("submitted_arguments", arguments(sol["signature"]))
        .withColumn("helper_count", F.size(decls) - F.when(sol.isNotNull(), 1).otherwise(0))
        .withColumn("solution_body", sol["body"])
        .drop("_file", "_violations", "_solution")
    )

"""Lexical measures of proofs and statements, one projection each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provelight import dims
from provelight.functions.lean import scan_column, strip_comments_column
from provelight.functions.text import all_of, bracket_depth, count_of, indent_depth, is_blank, java, lines_of, matches, rstrip, strip

STRUCTURE_FIELDS = (
    "lines code_lines tokens named_steps local_dependency_depth cited_lemmas auxiliary_declarations max_nesting_depth "
    "branch_points comment_segments comment_chars line_repetition_rate tactic_repetition_rate repeated_trigram_rate "
    "max_consecutive_duplicate_lines"
).split()
STATEMENT_FIELDS = (
    "binders hypotheses conclusion_tokens quantifiers connectives cited_definitions distinct_types total_tokens max_nesting_depth"
).split()


def _share(part: Column, whole: Column) -> Column:
    """1 - part / whole, 0 where there is nothing."""
    return F.coalesce(1 - F.try_divide(part, whole), F.lit(0.0))


def tactics(body: Column, language: str = "lean4") -> Column:
    """Tactic names in order, repeats kept; an unknown language has none.

    ``body`` is text without comments.  The tail of a qualified name and of a
    primed identifier is no tactic.
    """
    known = dims.VOCABULARIES.get(language)
    if not known:
        return F.array().cast("array<string>")
    names = F.regexp_extract_all(body, F.lit(r"(?<![.\p{L}\p{N}_'])([a-zA-Z_][a-zA-Z0-9_'!?]*)"), F.lit(1))
    return F.filter(names, lambda t: t.isin(*known))


def size_measures(raw: Column) -> dict[str, Column]:
    """Measures of a text as it stands, comments included, that built-in expressions can say; for texts that are not null."""
    block = r"/-[\s\S]*?-/"
    lines = lines_of(raw)
    code = F.filter(F.transform(lines, strip), lambda x: x != "")
    dashes = F.when(raw.contains("--"), F.regexp_count(F.regexp_replace(raw, block, " "), F.lit(r"--[^\n]*"))).otherwise(0)
    return {
        "chars": F.length(raw),
        "lines": F.size(lines),
        "max_line_chars": F.coalesce(F.array_max(F.transform(lines, F.length)), F.lit(0)),
        "code_lines": F.size(code),
        "tokens": count_of(raw, dims.TOKEN),
        "line_comments": dashes,
        "comment_segments": F.when(raw.contains("/-"), F.regexp_count(raw, F.lit(block))).otherwise(0) + dashes,
        "calc_blocks": count_of(raw, r"\bcalc\b"),
        "branch_points": count_of(raw, dims.BRANCH),
        "distinct_code_lines": F.size(F.array_distinct(code)),
    }


def add_structure(df: DataFrame, text: str, language: str | Column = "lean4", vocabulary: str = "lean4", strip_: bool = True) -> DataFrame:
    """Adds ``tactics`` and ``structure`` (24 measures) of a text column.

    Null texts measure as empty ones.  ``language`` decides what a comment is,
    ``vocabulary`` which words count as tactics.  With ``strip_`` False the text
    is measured as it stands.

    Comments, dependency chains, trigrams and nesting need every token in turn:
    one Arrow function gives them all.  The same as higher-order functions took
    ten times as long.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    work = df.withColumn("_scan", scan_column(raw, language, strip_))
    body, scan = F.col("_scan.body"), F.col("_scan")
    work = (
        work.withColumn("tactics", tactics(body, vocabulary))
        .withColumn("_code", F.filter(F.transform(lines_of(body), strip), lambda x: x != ""))
        .withColumn("_decls", all_of(body, dims.DECLARATION, 1))
    )
    block, doc = r"/-[\s\S]*?-/", r"/--[\s\S]*?-/"
    none = F.array().cast("array<string>")
    opened, dashed = raw.contains("/-"), raw.contains("--")
    work = (
        work.withColumn("_blocks", F.when(opened, F.regexp_extract_all(raw, F.lit(block), F.lit(0))).otherwise(none))
        .withColumn("_docs", F.when(opened, F.regexp_count(raw, F.lit(doc))).otherwise(0))
        .withColumn("_dashes", F.when(dashed, F.regexp_extract_all(F.regexp_replace(raw, block, " "), F.lit(r"--[^\n]*"), F.lit(0))).otherwise(none))
        .withColumn("_lines", lines_of(raw))
    )
    blocks, docs, line = F.col("_blocks"), F.col("_docs"), F.col("_dashes")
    chars_of = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + F.length(x))
    lines = F.col("_lines")
    used = F.col("tactics")
    fields = {
        "chars": F.length(raw),
        "lines": F.size(lines),
        "max_line_chars": F.coalesce(F.array_max(F.transform(lines, F.length)), F.lit(0)),
        "code_lines": F.size("_code"),
        "tokens": scan["tokens"],
        "doc_comments": docs,
        "block_comments": F.greatest(F.lit(0), F.size(blocks) - docs),
        "line_comments": F.size(line),
        "comment_segments": F.size(blocks) + F.size(line),
        "comment_chars": chars_of(blocks) + chars_of(line),
        "declarations": F.map_from_entries(
            F.transform(
                F.array_distinct("_decls"),
                lambda k: F.struct(k.alias("key"), F.size(F.filter("_decls", lambda d: d == k)).alias("value")),
            )
        ),
        "auxiliary_declarations": F.greatest(F.lit(0), F.size("_decls") - 1),
        "named_steps": scan["steps"],
        "local_dependency_depth": scan["depth"],
        "cited_lemmas": F.size(F.array_distinct(all_of(body, dims.QUALIFIED, 1))),
        "calc_blocks": count_of(body, r"\bcalc\b"),
        "max_nesting_depth": F.greatest(scan["brackets"], indent_depth(body)),
        "branch_points": count_of(body, dims.BRANCH),
        "term_mode": (raw != "") & ~matches(body, r"\bby\b") & (F.size(used) == 0),
        "distinct_code_lines": F.size(F.array_distinct("_code")),
        "line_repetition_rate": _share(F.size(F.array_distinct("_code")), F.size("_code")),
        "tactic_repetition_rate": _share(F.size(F.array_distinct(used)), F.size(used)),
        "repeated_trigram_rate": _share(scan["trigrams"], F.greatest(scan["tokens"] - 2, F.lit(0))),
        "max_consecutive_duplicate_lines": scan["run"],
    }
    work = work.withColumn("structure", F.struct(*[c.alias(n) for n, c in fields.items()]))
    return work.drop("_scan", "_code", "_decls", "_blocks", "_docs", "_dashes", "_lines")


def add_statement(df: DataFrame, statement: str, language: str | Column = "lean4") -> DataFrame:
    """Adds ``statement`` measures (11) as struct column ``statement_complexity``; blank statements measure 0."""
    raw = F.coalesce(F.col(statement), F.lit(""))
    head = F.substring_index(strip_comments_column(raw, language), ":=", 1)
    work = df.withColumn("_head", F.when(is_blank(raw), F.lit("")).otherwise(head))
    h = F.col("_head")
    types = F.transform(all_of(h, dims.BINDER, 3), strip)
    instance = F.transform(
        all_of(h, dims.INSTANCE_BINDER, 1),
        lambda x: strip(F.regexp_replace(x, r"^[^:]*:", "")),
    )
    openers = all_of(h, dims.BINDER, 1)
    both = F.filter(F.concat(types, instance), lambda x: x != "")
    normal = F.transform(both, lambda x: F.regexp_replace(x, r"(?U)\s+", " "))
    # What follows the last binder of either form; a greedy prefix finds it.
    last = f"(?s)^.*(?:{java(dims.BINDER).removeprefix('(?d)')}|{java(dims.INSTANCE_BINDER).removeprefix('(?d)')})"
    rest = F.regexp_replace(strip(F.regexp_replace(h, last, "")), r"(?U)^\s*:\s*", "")
    fields = {
        "binders": F.size(openers) + F.size(instance),
        "hypotheses": F.size(F.filter(types, lambda x: matches(x, dims.PROP_TYPE))),
        "implicit_binders": F.size(F.filter(openers, lambda x: x.isin("{", "⦃"))),
        "instance_binders": F.size(instance),
        "conclusion_tokens": F.size(all_of(rest, dims.TOKEN)),
        "quantifiers": count_of(h, dims.QUANTIFIER),
        "connectives": count_of(h, dims.CONNECTIVE),
        "cited_definitions": F.size(F.array_distinct(all_of(h, dims.QUALIFIED, 1))),
        "distinct_types": F.size(F.array_distinct(normal)),
        "total_tokens": F.size(all_of(h, dims.TOKEN)),
        "max_nesting_depth": bracket_depth(h, dims.OPENERS, dims.CLOSERS),
    }
    return work.withColumn("statement_complexity", F.struct(*[c.alias(n) for n, c in fields.items()])).drop("_head")


def assembled_source(statement: Column, header: Column, proof: Column, assembly: Column) -> Column:
    """The text handed to a prover: whole file, header and proof, or statement continued by the proof."""
    h, st = rstrip(F.coalesce(header, F.lit(""))), rstrip(F.coalesce(statement, F.lit("")))
    proof = F.coalesce(proof, F.lit(""))
    led = F.regexp_replace(proof, r"(?U)^\s+", "")
    tail = F.when(st.endswith(":=") & led.startswith(":="), F.substring(led, 3, 1 << 30)).otherwise(proof)
    joined = F.when(tail.startswith("\n"), F.concat(st, rstrip(tail))).when(
        ~is_blank(tail), F.concat(st, F.lit(" "), strip(tail))
    ).otherwise(st)
    full = lambda part: F.when(~is_blank(part), part)
    two = lambda part: F.concat(F.concat_ws("\n\n", full(h), full(part)), F.lit("\n"))
    return F.when(assembly == "full_file", proof).when(assembly == "header_plus_proof", two(proof)).otherwise(two(joined))

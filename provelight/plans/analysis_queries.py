"""Queries for the measures, classifiers and aggregates, with their SQL twins.

The Lean texts are ``attempts.proof``, the recorded outcomes ``results``, the
judged statements ``verdicts``; a participant is a model, a problem a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provelight import dims
from provelight.functions.lean import strip_comments_column
from provelight.operators import aggregate as A
from provelight.operators import classify as C
from provelight.operators import measure as M
from provelight.operators import screen as S
from provelight.operators import verdict as V
from provelight.functions.text import all_of, count_of, is_blank
from provelight.store import spread

METRICS = ("chars", "lines", "tokens", "max_line_chars", "named_steps")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _wide(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for work that is bound by the processor."""
    return spread(_read(spark, sf_dir, name).select(*columns))


def _results(spark: SparkSession, sf_dir: str):
    df = _read(spark, sf_dir, "results")
    return df, *A.outcome(F.col("status"))


def _structure_metrics() -> dict:
    return {m: F.col(f"structure.{m}") for m in METRICS}


def tactic_frequency(spark, sf_dir):
    df, v, s = _results(spark, sf_dir)
    return A.tactic_frequency(df, "tactics", v, s)


def tactic_totals(spark, sf_dir):
    return A.tactic_totals(_results(spark, sf_dir)[0], "tactics")


def edge_tactics(spark, sf_dir):
    return A.edge_tactics(_results(spark, sf_dir)[0], "tactics")


def transitions(spark, sf_dir):
    df, v, _ = _results(spark, sf_dir)
    return A.transitions(df, "tactics", v)


def top_transitions(spark, sf_dir):
    """The 20 most frequent transitions (a top-k report)."""
    return A.top(transitions(spark, sf_dir), "n", "pair", 20)


def tactic_positions(spark, sf_dir):
    return A.tactic_positions(_results(spark, sf_dir)[0], "tactics")


def structure_stats(spark, sf_dir):
    df, v, s = _results(spark, sf_dir)
    return A.structure_stats(df, _structure_metrics(), v, s)


def time_distribution(spark, sf_dir):
    df, _, _ = _results(spark, sf_dir)
    measured = df.where("wall_time_s >= 0 and not isnan(wall_time_s)")
    return A.distribution(measured, ["backend", "status"], "wall_time_s")


def correlations(spark, sf_dir):
    df, v, s = _results(spark, sf_dir)
    return A.correlations(df, _structure_metrics(), v, s, least=0.0)


def failure_stats(spark, sf_dir):
    return A.failure_stats(_results(spark, sf_dir)[0], "failure_mode", "model")


def success_stats(spark, sf_dir):
    return A.success_stats(_results(spark, sf_dir)[0], "success_mode", "model")


def first_error_position(spark, sf_dir):
    return A.first_error_position(_results(spark, sf_dir)[0], "diagnostics", F.col("structure.lines"))


def sample_duplication(spark, sf_dir):
    from provelight.functions.text import strip

    return A.sample_duplication(_read(spark, sf_dir, "attempts"), "task_id", strip(F.col("proof")))


def index_attempts(spark, sf_dir):
    """The attempts of every task in order, in chunks of bounded size."""
    df = A.index_attempts(_read(spark, sf_dir, "attempts"), "task_id", "record_id", F.col("attempt_id"))
    return df.select("task_id", "chunk", F.array_join("attempts", ",").alias("attempts"))


def error_kinds(spark, sf_dir):
    rows = _wide(spark, sf_dir, "results", "diagnostics").select(F.explode("diagnostics").alias("d")).where("d.message is not null")
    kind = C.error_kind(F.col("d.message"))
    return rows.groupBy(F.col("d.kind").alias("recorded"), kind.alias("found")).agg(F.count("*").alias("n"))


def failure_modes(spark, sf_dir):
    """Failure mode of every result, from its status, messages and proof."""
    r = _wide(spark, sf_dir, "results", "record_id", "attempt_id", "status", "error_kind", "diagnostics", "soundness.ok")
    # Rows delivered again share an attempt_id: the first delivered proof stands for it.
    # Of its text two facts count, so two flags are aggregated and joined, not the text.
    proof = F.coalesce("proof", F.lit(""))
    flags = F.struct(is_blank(proof).alias("blank"), C.looks_truncated(proof).alias("truncated"))
    first = _wide(spark, sf_dir, "attempts", "attempt_id", "record_id", "proof").select("attempt_id", "record_id", flags.alias("f"))
    first = first.groupBy("attempt_id").agg(F.min_by("f", "record_id").alias("f"))
    r = r.withColumn("messages", C.error_messages(F.col("diagnostics"))).drop("diagnostics")
    both = r.join(first, "attempt_id", "left")
    blank, truncated = F.coalesce("f.blank", F.lit(True)), F.coalesce("f.truncated", F.lit(False))
    mode = C.failure_mode_of(F.col("status"), F.col("error_kind"), F.col("messages"), blank, truncated, F.col("ok"))
    return both.select("record_id", mode.alias("mode"))


def success_modes(spark, sf_dir):
    """Kind of proof of every result, from its tactics and steps and from two counts over its attempt's proof."""
    body = F.col("body")
    counts = F.struct(
        F.greatest(F.lit(0), F.size(all_of(body, dims.DECLARATION)) - 1).alias("auxiliary"), count_of(body, r"\bcalc\b").alias("calc")
    )
    bare = strip_comments_column(F.coalesce("proof", F.lit("")))
    first = _wide(spark, sf_dir, "attempts", "attempt_id", "record_id", "proof").select("attempt_id", "record_id", bare.alias("body"))
    first = first.select("attempt_id", "record_id", counts.alias("c")).groupBy("attempt_id").agg(F.min_by("c", "record_id").alias("c"))
    r = _read(spark, sf_dir, "results").select("record_id", "attempt_id", "tactics", "structure.named_steps", "structure.term_mode")
    mode = C.success_mode(F.col("tactics"), F.col("named_steps"), F.col("term_mode"), F.col("c.auxiliary"), F.col("c.calc"))
    return r.join(first, "attempt_id", "left").select("record_id", mode.alias("mode"))


def invented_names(spark, sf_dir):
    names = _read(spark, sf_dir, "results").select(F.explode(C.invented_names(F.col("diagnostics"))).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n"))


def truncated_look(spark, sf_dir):
    return _wide(spark, sf_dir, "attempts", "record_id", "proof").where("proof is not null").select("record_id", C.looks_truncated(F.col("proof")).alias("truncated"))


def proof_sizes(spark, sf_dir):
    """The measures of every proof as it stands, comments included."""
    df = _wide(spark, sf_dir, "attempts", "record_id", "proof")
    names = "chars lines max_line_chars code_lines tokens line_comments comment_segments calc_blocks branch_points distinct_code_lines".split()
    sizes = M.size_measures(F.coalesce("proof", F.lit("")))
    return df.select("record_id", *[sizes[n].alias(n) for n in names])


def proof_structure(spark, sf_dir):
    """All 24 measures of every proof without its comments."""
    df = M.add_structure(_wide(spark, sf_dir, "attempts", "record_id", "proof"), "proof")
    return df.select("record_id", "structure.*").drop("declarations")


def proof_repetition(spark, sf_dir):
    df = M.add_structure(_wide(spark, sf_dir, "attempts", "record_id", "proof"), "proof", strip_=False)
    names = ("line_repetition_rate", "repeated_trigram_rate", "max_consecutive_duplicate_lines")
    return df.select("record_id", *[F.col(f"structure.{n}").alias(n) for n in names])


def extracted_tactics(spark, sf_dir):
    body = strip_comments_column(F.coalesce("proof", F.lit("")))
    names = _wide(spark, sf_dir, "attempts", "proof").select(body.alias("body")).select(F.explode(M.tactics(F.col("body"))).alias("tactic"))
    return names.groupBy("tactic").agg(F.count("*").alias("n"))


def statement_complexity(spark, sf_dir):
    df = M.add_statement(_read(spark, sf_dir, "tasks"), "formal_statement")
    return df.select("task_id", "statement_complexity.*")


def assembled_sources(spark, sf_dir):
    t = _read(spark, sf_dir, "tasks").select("task_id", "formal_statement", "header", "assembly")
    a = _wide(spark, sf_dir, "attempts", "record_id", "task_id", "proof")
    source = M.assembled_source(F.col("formal_statement"), F.col("header"), F.col("proof"), F.col("assembly"))
    return a.join(t, "task_id").select("record_id", F.sha2(source, 256).alias("content_hash"), F.length(source).alias("chars"))


def screened_sources(spark, sf_dir):
    """Rules that fire on the assembled sources, with the number of sources, by language of the task."""
    t = _read(spark, sf_dir, "tasks").select("task_id", "formal_statement", "header", "assembly", "language")
    a = _wide(spark, sf_dir, "attempts", "task_id", "proof").join(t, "task_id")
    source = M.assembled_source(F.col("formal_statement"), F.col("header"), F.col("proof"), F.col("assembly"))
    # A statement the engine itself put in front of the proof cannot be altered.
    required = F.when(F.col("assembly") != "continue_statement", F.col("formal_statement"))
    df = S.add_violations(a.select("language", source.alias("source"), required.alias("required")), "source", F.col("language"), F.col("required"))
    rows = df.select("language", F.explode(F.array_distinct(F.transform("violations", lambda v: S.label_parts(v)[1]))).alias("rule"))
    return rows.groupBy("language", "rule").agg(F.count("*").alias("n"))


def screened_statements(spark, sf_dir):
    """Problems whose own statement or header rests on something unchecked."""
    t = _read(spark, sf_dir, "tasks")
    text = F.concat_ws("\n", "header", "formal_statement")
    df = S.add_violations(t.select("task_id", "language", text.alias("source")), "source", F.col("language"), None, dims.STATEMENT_CLASSES, subject="problem")
    return df.select("task_id", F.size("violations").alias("n_violations"))


def hack_histogram(spark, sf_dir):
    df = _read(spark, sf_dir, "results").select(F.filter("soundness.violations", lambda v: v.isNotNull()).alias("violations"))
    labelled = df.select(F.transform("violations", lambda v: F.regexp_replace(v, "^\\[([a-z_]+):([a-z]+)\\]", "[$1:$2]")).alias("violations"))
    return A.hack_histogram(labelled, "violations")


def axiom_audit(spark, sf_dir):
    """Audit of the names a result says are unknown, taken as its axiom list (NULL without errors)."""
    names = C.invented_names(F.col("diagnostics"))
    df = _read(spark, sf_dir, "results").select(F.when(F.size("diagnostics") > 0, names).alias("axioms"))
    rows = df.select(F.explode(S.axiom_violations(F.col("axioms"))).alias("v"))
    return rows.groupBy(S.label_parts(F.col("v"))[1].alias("rule")).agg(F.count("*").alias("n"))


def leaderboard(spark, sf_dir):
    df = _read(spark, sf_dir, "results").where("model is not null")
    return A.leaderboard(df, "model", "task_id", F.col("status") == "verified", _read(spark, sf_dir, "tasks").count())


def problem_stats(spark, sf_dir):
    df = _read(spark, sf_dir, "results").select("task_id", "status", "error_kind")
    stage = F.when(F.col("status") == "rejected", "interface").when(F.col("status") == "failed", "kernel")
    return A.problem_stats(_read(spark, sf_dir, "tasks"), df, "task_id", F.col("status") == "verified", stage, ~F.col("status").isin("error", "skipped"))


def refusal_reasons(spark, sf_dir):
    first = F.get(F.filter("diagnostics", lambda d: d.isNotNull() & (d["severity"] == "error")), F.lit(0))["message"]
    df = _read(spark, sf_dir, "results").where("status <> 'verified'").select(F.substring_index(first, "\n", 1).alias("reason"))
    return A.reasons(df, "reason")


def ranked_reasons(spark, sf_dir):
    df = _read(spark, sf_dir, "results").where("error_kind is not null")
    return A.ranked(df, "error_kind", "record_id")


def statement_summary(spark, sf_dir):
    df = _read(spark, sf_dir, "verdicts")
    return V.statement_summary(df, V.statement_status(F.col("checks")), "checks")


def usage_totals(spark, sf_dir):
    return V.usage_totals(_read(spark, sf_dir, "verdicts"), "judge.usage")


def consensus_labels(spark, sf_dir):
    df = _read(spark, sf_dir, "verdicts").where("judge is not null")
    return df.select("record_id", V.consensus(F.col("judge.samples")).alias("label"))


def health_summary(spark, sf_dir):
    return V.health_summary(_read(spark, sf_dir, "verdicts"), "checks")


def health_states(spark, sf_dir):
    df = _read(spark, sf_dir, "verdicts")
    return df.groupBy(V.health(F.col("checks")).alias("state")).agg(F.count("*").alias("n"))


def mock_verdicts(spark, sf_dir):
    """Verdicts of the stand-in prover for every proof, by a stable draw."""
    df = _read(spark, sf_dir, "attempts").where("proof is not null")
    v = V.mock_verdict(F.col("proof"), F.col("proof"), "seed", 0.3)
    return df.select("record_id", v["status"].alias("status"), v["error_kind"].alias("error_kind"))


def latest_results(spark, sf_dir):
    """The last delivered result of every attempt and backend."""
    df = _read(spark, sf_dir, "results").select("attempt_id", "backend", "record_id", "status", "ingested_at")
    return V.latest_stages(df, ["attempt_id"], "backend", ["ingested_at", "record_id"]).select("attempt_id", "backend", "record_id", "status")


def prover_messages(spark, sf_dir):
    """Messages of provers in both streams of runs, with kinds."""
    runs = _wide(spark, sf_dir, "container_runs", "run_id", "stdout", "stderr")
    streams = F.explode(F.array(*[F.struct(F.lit(s).alias("stream"), F.col(s).alias("log")) for s in ("stdout", "stderr")]))
    logs = runs.select("run_id", streams.alias("s")).select("run_id", "s.*").where("log is not null")
    df = C.parse_prover_log(logs, ["run_id", "stream"], "log")
    return df.groupBy("stream", "severity", "kind").agg(F.count("*").alias("n"), F.sum("line").alias("line_sum"))


def answers_split(spark, sf_dir):
    """Results whose task is known and those whose task is not, from one join."""
    r = _read(spark, sf_dir, "results").select("record_id", "task_id")
    t = _read(spark, sf_dir, "tasks").select("task_id", F.lit(True).alias("known"))
    return r.join(t, "task_id", "left").groupBy(F.coalesce("known", F.lit(False)).alias("recognized")).agg(F.count("*").alias("n"))


def repeated_tactics(spark, sf_dir):
    """Tactics a proof uses more often than the first delivery of its attempt did (a multiset difference)."""
    r = _read(spark, sf_dir, "results")
    theirs = r.select("task_id", F.explode("tactics").alias("tactic"))
    base = r.where("sample_index = 0").select("task_id", F.explode("tactics").alias("tactic"))
    return S.multiset_excess(theirs, base, ["task_id"], "tactic")


NAMES = (
    "tactic_frequency tactic_totals edge_tactics transitions top_transitions tactic_positions structure_stats time_distribution "
    "correlations failure_stats success_stats first_error_position sample_duplication index_attempts error_kinds failure_modes "
    "success_modes invented_names truncated_look proof_sizes proof_structure proof_repetition extracted_tactics statement_complexity "
    "assembled_sources screened_sources screened_statements hack_histogram axiom_audit leaderboard problem_stats refusal_reasons ranked_reasons "
    "statement_summary usage_totals consensus_labels health_summary health_states mock_verdicts latest_results prover_messages "
    "answers_split repeated_tactics"
).split()


#: Sums and means of doubles depend on the order of the rows in their last digits, so these
#: columns are rounded to six decimals, in the SQL twins too.
_DISTRIBUTION = ("mean", "median", "stdev", "min", "p25", "p75", "p90", "max", "total")
ROUNDED = {
    "tactic_totals": ("mean_distinct", "mean_invocations"),
    "tactic_positions": ("mean_position",),
    "structure_stats": _DISTRIBUTION,
    "time_distribution": _DISTRIBUTION,
    "correlations": ("r", "mean_verified", "mean_failed"),
    "success_stats": ("substantive_fraction", "automation_fraction"),
    "first_error_position": ("mean_first_error_position",),
    "sample_duplication": ("mean_duplicate_fraction",),
    "usage_totals": ("estimated_cost_usd",),
}


def _rounded(name: str):
    run, columns = globals()[name], ROUNDED[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, sf_dir).withColumns({c: F.round(c, 6) for c in columns})

    query.__doc__ = run.__doc__
    return query


def queries() -> dict:
    return {name: _rounded(name) if name in ROUNDED else globals()[name] for name in NAMES}


# --- SQL twins -------------------------------------------------------------------
def _quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


def _cases(column: str, rules, otherwise: str) -> str:
    return "case " + " ".join(f"when regexp_matches({column}, '{_re2(p)}', 'i') then '{n}'" for p, n in rules) + f" else {otherwise} end"


_V = "coalesce(status = 'verified', false)"
_S = f"coalesce(status in ({_quoted(dims.SCOREABLE)}), false)"
_T = f"t as (select record_id, {_V} v, {_S} s, tactics, len(tactics) n from results)"
_LONG = "m as (" + " union all ".join(
    f"select {i} ordinal, '{m}' metric, structure.{m}::double x, {_V} v, {_S} s from results where structure is not null" for i, m in enumerate(METRICS)
) + ")"
_DIST = """count(x) n, avg(x) mean, quantile_cont(x, 0.5) median, stddev_pop(x) stdev, min(x) "min", quantile_cont(x, 0.25) p25,
 quantile_cont(x, 0.75) p75, quantile_cont(x, 0.9) p90, max(x) "max", sum(x) total"""
_SPACE = r"[\s\x{0B}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = lambda c: f"regexp_replace(regexp_replace({c}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"
_FIRST_PROOF = "fp as (select attempt_id, arg_min(coalesce(proof, chr(0)), record_id) p from attempts group by attempt_id)"
_MESSAGES = "array_to_string(list_transform(list_filter(diagnostics, lambda d: d is not null and d.severity = 'error'), lambda d: d.message), chr(10))"
_ALL_PROOFS = "(select record_id, coalesce(proof, '') proof from attempts)"
_TRUNC = f"""(rt <> '' and (len(regexp_extract_all(rt, '[(\\[{{⟨⦃]')) > len(regexp_extract_all(rt, '[)\\]}}⟩⦄]'))
 or regexp_matches(rt, '{_re2(dims.TRUNCATED_TAIL)}')))"""
_RT = lambda c: f"regexp_replace({c}, '{_SPACE}+$', '')"


# A text without comments, for texts whose comments do not nest and whose strings hold none.
_BARE = lambda c: f"regexp_replace(regexp_replace(coalesce({c}, ''), '/-(.|\\n)*?(-/|\\z)', ' ', 'g'), '--[^\\n]*', ' ', 'g')"
_ROOTS = _quoted(dims.ALLOWED_IMPORTS)
_ODD_IMPORTS = f"case when language = 'lean4' then len(list_filter(regexp_extract_all(b, '{_re2(dims.IMPORT)}', 1), lambda m: string_split(m, '.')[1] not in ({_ROOTS}))) else 0 end"
_GLYPH = f"len(list_filter(regexp_extract_all(b, '{_re2(dims.GLYPH_WORD)}'), lambda w: regexp_matches(w, '[{dims.CYRILLIC_LOOKALIKES}]') and regexp_matches(w, '[A-Za-z]'))) > 0"


def _fired(classes) -> str:
    """How many rules of these classes match ``b``, a text without comments in ``language``."""
    rules = [(languages, pattern) for _, hack, languages, pattern, _ in dims.SCREEN_RULES if hack in classes]
    return " + ".join(f"(language in ({_quoted(languages)}) and regexp_matches(b, '{_re2(pattern)}'))::int" for languages, pattern in rules)


_ASSEMBLED = f"""k as (select *, regexp_replace(p, '^{_SPACE}+', '') led from j), l as (select *, case when st like '%:=' and led like ':=%' then substr(led, 3) else p end tail from k),
 m as (select *, case when tail like chr(10) || '%' then st || {_RT("tail")} when {_STRIP("tail")} <> '' then st || ' ' || {_STRIP("tail")} else st end joined from l)"""
_SOURCE = f"""case when assembly = 'full_file' then p else array_to_string(list_filter([h, case when assembly = 'header_plus_proof' then p else joined end],
 lambda x: {_STRIP("x")} <> ''), chr(10) || chr(10)) || chr(10) end"""


def _screened_sources() -> str:
    """Rules, imports, lookalikes and the checks against a required statement, each stated on its own."""
    rules = " union all ".join(
        f"select language, '{rule}' rule from t where language in ({_quoted(languages)}) and regexp_matches(b, '{_re2(pattern)}')"
        for rule, _, languages, pattern, _ in dims.SCREEN_RULES
    )
    one = lambda c: "regexp_replace(" + c + f", '{_SPACE}+', ' ', 'g')"
    seam = lambda c: "regexp_replace(" + _STRIP(one(c)) + ", ':=\\s*(by\\b.*)?$', '')"
    normal = lambda c: "regexp_replace(" + _STRIP(seam(c)) + ", '[:= ]+$', '')"
    names = f"""list_filter(list_distinct(regexp_extract_all(regexp_replace(q, '{_re2(dims.STATEMENT_HEAD)}', ' '), '{_re2(dims.STATEMENT_NAME)}')),
 lambda n: n not in ({_quoted(dims.COMMON_IDENTIFIERS)}) and length(n) > 1)"""
    return f"""with j as (select language, coalesce(proof, '') p, assembly, {_RT("coalesce(header, '')")} h, {_RT("coalesce(formal_statement, '')")} st,
 case when assembly <> 'continue_statement' then formal_statement end req from attempts join tasks using (task_id)), {_ASSEMBLED},
 t as (select language, {_BARE("src")} b, case when req is not null then {_BARE("req")} end q from (select language, req, {_SOURCE} src from m)),
 n as (select *, {names} ns from t where q is not null),
 f as ({rules}
 union all select language, 'lean.unknown_import' from t where {_ODD_IMPORTS} > 0
 union all select language, 'generic.homoglyph_identifier' from t where {_GLYPH}
 union all select language, 'generic.statement_altered' from n where {normal("q")} <> '' and not contains({normal("b")}, {normal("q")})
 union all select language, 'lean.redefines_statement_term' from n where language in ('lean4', 'lean3') and list_has_any(regexp_extract_all(b, '{_re2(dims.DECLARED_NAME)}', 1), ns)
 union all select language, 'lean.open_shadows_statement' from n where len(list_filter(flatten(list_transform(list_filter(regexp_extract_all(b, '{_re2(dims.OPEN)}', 1),
 lambda o: not regexp_matches(o, 'hiding\\s+([^\\n]+)')), lambda o: regexp_extract_all(string_split(o, ' in ')[1], '{_re2(dims.STATEMENT_NAME)}'))),
 lambda s: s not in ('hiding', 'renaming', 'in') and list_contains(list_concat(ns, list_transform(ns, lambda x: string_split(x, '.')[-1])), string_split(s, '.')[-1]))) > 0
 union all select language, 'lean.notation_redefinition' from n where regexp_matches(b, '{_re2(dims.NOTATION)}'))
 select language, rule, count(*) n from f group by language, rule"""


def oracle_sql() -> dict[str, str]:
    twins = _twins()
    for name, columns in ROUNDED.items():
        replaced = ", ".join(f'round("{c}", 6) as "{c}"' for c in columns)
        twins[name] = f"select * replace ({replaced}) from ({twins[name]})"
    return twins


def statement_health_sql() -> str:
    """Twin of the query over statements and their recorded verdicts."""
    return f"""with t as (select task_id, language, {_BARE("concat_ws(chr(10), header, formal_statement)")} b from tasks),
 v as (select task_id, max(case status when 'ok' then 'verified' when 'unfaithful' then 'failed' else 'skipped' end) s from verdicts group by task_id)
 select case when {_fired(dims.STATEMENT_CLASSES)} + {_ODD_IMPORTS} + ({_GLYPH})::int > 0 or coalesce(s, '') = 'failed' then 'ungradeable' else 'clean' end state, count(*) n
 from t left join v using (task_id) group by 1"""


def _twins() -> dict[str, str]:
    fallback = "case ek " + " ".join(f"when '{k}' then '{m}'" for k, m in dims.FAILURE_FALLBACK.items()) + " else 'unclassified' end"
    lines = "case when proof = '' then [] else regexp_split_to_array(regexp_replace(proof, '(\\r\\n|[\\n\\x{0B}\\f\\r\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}])\\z', ''), '\\r\\n|[\\n\\x{0B}\\f\\r\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]') end"
    code = f"list_filter(list_transform(ls, lambda x: {_STRIP('x')}), lambda x: x <> '')"
    modes = "case " + " ".join(f"when mode = '{m}' then '{a}'" for m, a in dims.FAILURE_MODES.items()) + " end"
    token = _re2("[A-Za-z_][A-Za-z0-9_'!?.]*|\\p{Nd}+|[^\\s\\x{0B}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}A-Za-z0-9_]")
    return {
        "tactic_frequency": f"""with {_T}, e as (select record_id, v, s, unnest(tactics) tactic from t),
 p as (select tactic, record_id, v and s v, s and not v f, count(*) n from e group by all)
 select tactic, sum(n)::bigint uses, count(*) proofs_using, count(*) filter (v) in_verified, count(*) filter (f) in_failed,
 coalesce(count(*) filter (v) / nullif(count(*) filter (v) + count(*) filter (f), 0), 0.0) success_rate,
 tactic in ({_quoted(dims.SUSPECT_TACTICS)}) suspect from p group by tactic""",
        "tactic_totals": """select count(*) proofs_measured, count(*) filter (len(tactics) = 0) proofs_without_tactics, sum(len(tactics))::bigint total_invocations,
 avg(len(list_distinct(tactics))) mean_distinct, avg(len(tactics)) mean_invocations from results where tactics is not null""",
        "edge_tactics": """select tactic, sum(a)::bigint as_first, sum(b)::bigint as_last from (select tactics[1] tactic, 1 a, 0 b from results where len(tactics) > 0
 union all select tactics[-1], 0, 1 from results where len(tactics) > 0) group by tactic""",
        "transitions": f"""with {_T}, e as (select record_id, v, unnest(tactics) a, unnest(generate_series(1, n)) i, tactics from t),
 p as (select a || '->' || tactics[i + 1] pair, v from e where i < len(tactics))
 select pair, count(*) n, count(*) filter (v) n_verified, count(*) filter (v) / count(*) success_rate from p group by pair""",
        "top_transitions": f"""with {_T}, e as (select record_id, v, unnest(tactics) a, unnest(generate_series(1, n)) i, tactics from t),
 p as (select a || '->' || tactics[i + 1] pair, v from e where i < len(tactics))
 select pair, count(*) n, count(*) filter (v) n_verified, count(*) filter (v) / count(*) success_rate from p group by pair order by n desc, pair limit 20""",
        "tactic_positions": f"""with {_T}, e as (select unnest(tactics) tactic, unnest(generate_series(0, n - 1)) i, n from t)
 select tactic, avg(i / greatest(1, n - 1)) mean_position, count(*) n from e group by tactic""",
        "structure_stats": f"""with {_LONG}, c as (select metric, 'pooled' cohort, x from m union all select metric, 'verified', x from m where s and v
 union all select metric, 'failed', x from m where s and not v) select metric, cohort, {_DIST} from c where x is not null group by metric, cohort""",
        "time_distribution": f"""select backend, status, {_DIST} from (select backend, status, wall_time_s x from results where wall_time_s >= 0 and not isnan(wall_time_s)) group by backend, status""",
        "correlations": f"""with {_LONG}, a as (select metric, count(x) n, covar_pop(x, v::int) / nullif(stddev_pop(x) * stddev_pop(v::int), 0) r,
 avg(x) filter (v) mean_verified, avg(x) filter (not v) mean_failed from m where s and x is not null group by metric)
 select metric, n, r, mean_verified, mean_failed, case when abs(r) >= 0.5 then 'strong' when abs(r) >= 0.3 then 'moderate' when abs(r) >= 0.1 then 'weak'
 else 'negligible' end strength, case when r > 0 then 'positive' when r < 0 then 'negative' else 'none' end direction from a where n >= 3 and r is not null""",
        "failure_stats": f"""with f as (select case when failure_mode in ({_quoted(dims.FAILURE_MODES)}) then failure_mode else 'unclassified' end mode, model from results where failure_mode is not null)
 select 'mode' kind, mode "name", null::varchar model, count(*) n from f group by mode
 union all select 'attribution', {modes}, null, count(*) from f group by 2
 union all select 'model_mode', mode, model, count(*) from f where model is not null group by mode, model""",
        "success_stats": f"""with s as (select model, success_mode m from results where success_mode is not null)
 select model, over_all, successes, substantive_fraction, automation_fraction from (
 select model, 0::tinyint over_all, count(*) successes, avg((m in ({_quoted(k for k, y in dims.SUCCESS_MODES.items() if y)}))::int) substantive_fraction,
 avg((m in ('one_liner_automation', 'brute_force_decide'))::int) automation_fraction from s group by model
 union all select null, 1::tinyint, count(*), avg((m in ({_quoted(k for k, y in dims.SUCCESS_MODES.items() if y)}))::int),
 avg((m in ('one_liner_automation', 'brute_force_decide'))::int) from s)""",
        "first_error_position": """with e as (select list_filter(diagnostics, lambda d: d is not null and d.severity = 'error' and d.line > 0)[1].line l, structure.lines n from results)
 select avg(least(1.0, greatest(0.0, l / n))) mean_first_error_position, count(*) n from e where l > 0 and n > 0""",
        "sample_duplication": f"""with t as (select task_id, count(*) n, count(distinct coalesce({_STRIP('proof')}, '')) d from attempts group by task_id having count(*) > 1)
 select count(*) tasks_with_multiple_samples, count(*) filter (d < n) tasks_with_duplicates, count(*) filter (d = 1) tasks_all_identical,
 avg(1 - d / n) mean_duplicate_fraction, avg(1 - d / n) >= 0.25 or count(*) filter (d = 1) > 0 undermines_pass_at_k from t""",
        "index_attempts": "select task_id, record_id // 10000 chunk, string_agg(attempt_id, ',' order by record_id) attempts from attempts group by task_id, record_id // 10000",
        "error_kinds": f"""select d.kind recorded, {_cases('d.message', dims.ERROR_KINDS, "'unknown'")} "found", count(*) n
 from (select unnest(diagnostics) d from results) where d.message is not null group by 1, 2""",
        "failure_modes": f"""with {_FIRST_PROOF}, b as (select record_id, status, error_kind ek, coalesce(soundness.ok, true) ok, coalesce({_MESSAGES}, '') msg,
 coalesce(nullif(p, chr(0)), '') proof from results left join fp using (attempt_id)), r as (select *, {_RT('proof')} rt from b)
 select record_id, case when status = 'verified' then null when status = 'rejected' or not ok then 'reward_hacking' when status = 'timeout' then 'wall_clock_timeout'
 when status = 'skipped' then 'language_mismatch' when ek = 'toolchain' then 'toolchain_error' when ek = 'harness' or status = 'error' then 'harness_error'
 when {_STRIP('proof')} = '' then 'empty_proof'
 when regexp_matches(msg, 'unexpected end of input', 'i') or ({_TRUNC} and (msg = '' or regexp_matches(msg, 'unexpected token|expected', 'i'))) then 'truncated_output'
 else {_cases('msg', dims.FAILURE_PATTERNS, fallback)} end mode from r""",
        "success_modes": f"""with {_FIRST_PROOF}, b as (select attempt_id, {_BARE("nullif(p, chr(0))")} b from fp),
 s as (select record_id, coalesce(tactics, []) t, coalesce(structure.named_steps, 0) k, coalesce(structure.term_mode, false) tm,
 coalesce(len(regexp_extract_all(b, '{_re2(dims.DECLARATION)}')) - 1, 0) aux, coalesce(len(regexp_extract_all(b, '\\bcalc\\b')), 0) calc from results left join b using (attempt_id))
 select record_id, case when aux > 0 then 'auxiliary_lemmas' when list_has_any(t, [{_quoted(dims.INDUCTION_TACTICS)}]) then 'induction' when calc > 0 then 'calc_chain' when list_has_any(t, [{_quoted(dims.CASE_TACTICS)}]) then 'case_analysis'
 when k > 0 then 'structured_with_steps' when tm then 'term_mode' when len(t) = 0 then 'unclassified'
 when len(t) = 1 then case when t[1] in ({_quoted(dims.DECISION_TACTICS)}) then 'brute_force_decide' else 'one_liner_automation' end
 when list_has_all([{_quoted(dims.DECISION_TACTICS)}], t) then 'brute_force_decide'
 when len(t) <= 2 and list_has_all([{_quoted(dims.AUTOMATION_TACTICS)}], t) then 'one_liner_automation'
 when len(t) <= 5 then 'short_tactic_chain' else 'long_tactic_chain' end mode from s""",
        "invented_names": f"""with d as (select unnest(diagnostics) d from results), n as (select unnest(regexp_extract_all(d.message, '(?i){_re2(dims.INVENTED_NAME)}', 1)) "name" from d)
 select "name", count(*) n from n group by "name\"""",
        "truncated_look": f"with r as (select record_id, {_RT('proof')} rt from attempts where proof is not null) select record_id, {_TRUNC} truncated from r",
        "proof_sizes": f"""with a as (select record_id, proof, {lines} ls, regexp_replace(proof, '/-(.|\\n)*?-/', ' ', 'g') nb from {_ALL_PROOFS}),
 b as (select *, {code} code from a)
 select record_id, length(proof)::int chars, len(ls)::int lines, coalesce(list_max(list_transform(ls, lambda x: length(x))), 0)::int max_line_chars, len(code)::int code_lines,
 len(regexp_extract_all(proof, '{token}'))::int tokens, len(regexp_extract_all(nb, '--[^\\n]*'))::int line_comments,
 (len(regexp_extract_all(proof, '/-(?:.|\\n)*?-/')) + len(regexp_extract_all(nb, '--[^\\n]*')))::int comment_segments,
 len(regexp_extract_all(proof, '\\bcalc\\b'))::int calc_blocks, len(regexp_extract_all(proof, '{_re2(dims.BRANCH)}'))::int branch_points,
 len(list_distinct(code))::int distinct_code_lines from b""",
        "hack_histogram": """with v as (select unnest(soundness.violations) v from results), s as (select unnest(string_split(v, '; ')) x from v where v is not null),
 l as (select regexp_extract(x, '^\\[([a-z_]+):([a-zA-Z0-9_.]+)\\]', 1) c, regexp_extract(x, '^\\[([a-z_]+):([a-zA-Z0-9_.]+)\\]', 2) r from s)
 select c "class", r "rule", count(*) n from l where r <> '' and c <> 'placeholder' group by c, r""",
        "leaderboard": """with p as (select model participant, count(*) filter (status = 'verified') solved, count(*) attempted, count(distinct task_id) tried from results where model is not null group by model)
 select row_number() over (order by solved desc, attempted, participant)::int "rank", participant, solved, attempted, attempted - solved rejected,
 greatest(0, (select count(*) from tasks) - tried) not_attempted from p""",
        "problem_stats": """with a as (select task_id, count(*) attempted, count(*) filter (status = 'verified') solved, count(*) filter (status = 'rejected') refused_at_interface,
 count(*) filter (status = 'failed') refused_at_kernel, 0::bigint refused_at_replay, 0::bigint refused_at_dependencies, 0::bigint refused_at_axioms,
 count(*) filter (status in ('error', 'skipped')) not_compiled from results group by task_id)
 select task_id, coalesce(attempted, 0) attempted, coalesce(solved, 0) solved, coalesce(refused_at_interface, 0) refused_at_interface, coalesce(refused_at_kernel, 0) refused_at_kernel,
 coalesce(refused_at_replay, 0) refused_at_replay, coalesce(refused_at_dependencies, 0) refused_at_dependencies, coalesce(refused_at_axioms, 0) refused_at_axioms,
 coalesce(not_compiled, 0) not_compiled, coalesce(solved / nullif(attempted, 0), 0.0) solve_rate from (select distinct task_id from tasks) full join a using (task_id)""",
        "refusal_reasons": """with f as (select string_split(list_filter(diagnostics, lambda d: d is not null and d.severity = 'error')[1].message, chr(10))[1] r from results where status <> 'verified')
 select left(trim(string_split(r, '(')[1]), 90) reason, count(*) n from f where r is not null group by 1""",
        "ranked_reasons": "select error_kind, count(*) n, min(record_id) first_seen from results where error_kind is not null group by error_kind",
        "statement_summary": """with c as (select coalesce(len(list_filter(checks, lambda c: c.passed = false)), 0) f, coalesce(len(list_filter(checks, lambda c: c.passed = true)), 0) t from verdicts)
 select case when f > 0 then 'unfaithful' when t > 0 then 'ok' else 'inconclusive' end status, count(*) n, sum(f)::bigint failed_checks, count(*) filter (f + t > 0) assessed from c group by 1""",
        "usage_totals": """select sum(judge.usage.input_tokens)::bigint input_tokens, sum(judge.usage.output_tokens)::bigint output_tokens, sum(judge.usage.cache_read_input_tokens)::bigint cache_read_input_tokens,
 sum(judge.usage.cache_creation_input_tokens)::bigint cache_creation_input_tokens, sum(judge.usage.calls)::bigint calls, sum(judge.usage.estimated_cost_usd) estimated_cost_usd from verdicts""",
        "consensus_labels": """with s as (select record_id, unnest(judge.samples) l from verdicts where judge is not null), c as (select record_id, l, count(*) n from s where l is not null group by all),
 m as (select record_id, max(n) n from c group by record_id), w as (select record_id, count(*) k, min(l) l from c join m using (record_id, n) group by record_id)
 select v.record_id, case when k > 1 then 'unsure' else l end "label" from verdicts v left join w using (record_id) where judge is not null""",
        "health_summary": """with c as (select unnest(checks) c from verdicts) select c.kind kind, count(*) n, count(*) filter (c.passed) passed, count(*) filter (not c.passed) failed,
 count(*) filter (c.passed is null) "open", count(*) filter (not c.passed and c.fatal) fatal_failures from c where c is not null group by 1""",
        "health_states": """with c as (select list_filter(checks, lambda c: c.passed = false and c.fatal) a, list_filter(checks, lambda c: c.passed = false) b, list_filter(checks, lambda c: c.passed is not null) d from verdicts)
 select case when len(a) > 0 then 'ungradeable' when len(b) > 0 then 'suspect' when len(d) > 0 then 'clean' else 'unprobed' end state, count(*) n from c group by 1""",
        "latest_results": """select attempt_id, backend, record_id, status from results qualify row_number() over (partition by attempt_id, backend order by ingested_at desc, record_id desc) = 1""",
        "mock_verdicts": f"""with d as (select record_id, proof, ('0x' || left(sha256('seed' || proof), 16))::ubigint::double / 18446744073709551616.0 x from attempts where proof is not null)
 select record_id, case {" ".join(f"when contains(proof, '{m}') then '{s}'" for m, s, _ in dims.MOCK_MARKERS)} when x < 0.3 then 'verified' else 'failed' end status,
 case {" ".join(f"when contains(proof, '{m}') then {'null' if k is None else repr(k)}" for m, _, k in dims.MOCK_MARKERS)} when x < 0.3 then null else 'unsolved_goals' end error_kind from d""",
        "extracted_tactics": f"""with b as (select regexp_replace(regexp_replace(proof, '/-(.|\\n)*?(-/|\\z)', ' ', 'g'), '--[^\\n]*', ' ', 'g') b from attempts where proof is not null),
 r as (select unnest(regexp_extract_all(b, '[\\p{{L}}\\p{{N}}_.''!?]+')) r from b), w as (select regexp_extract(r, '^[a-zA-Z_][a-zA-Z0-9_''!?]*') w from r)
 select w tactic, count(*) n from w where w in ({_quoted(dims.LEAN_TACTICS)}) group by w""",
        "axiom_audit": f"""with a as (select case when len(diagnostics) > 0 then list_sort(list_distinct(list_filter(flatten(list_transform(list_filter(diagnostics, lambda d: d is not null),
 lambda d: regexp_extract_all(coalesce(d.message, ''), '(?i){_re2(dims.INVENTED_NAME)}', 1))), lambda n: n not in ({_quoted(dims.ALLOWED_AXIOMS)})))) end a from results),
 v as (select case when a is null then ['kernel.audit_missing'] else list_transform(a, lambda n: case when n = 'sorryAx' then 'kernel.sorry_ax'
 when n in ({_quoted(dims.COMPILER_AXIOMS)}) then 'kernel.compiler_trust' else 'kernel.nonstandard_axiom' end) end v from a), u as (select unnest(v) rule from v)
 select rule, count(*) n from u group by rule""",
        "screened_sources": _screened_sources(),
        "assembled_sources": f"""with j as (select record_id, coalesce(proof, '') p, assembly, {_RT("coalesce(header, '')")} h, {_RT("coalesce(formal_statement, '')")} st from attempts join tasks using (task_id)),
 k as (select *, regexp_replace(p, '^{_SPACE}+', '') led from j), l as (select *, case when st like '%:=' and led like ':=%' then substr(led, 3) else p end tail from k),
 m as (select *, case when tail like chr(10) || '%' then st || {_RT("tail")} when {_STRIP("tail")} <> '' then st || ' ' || {_STRIP("tail")} else st end joined from l),
 s as (select record_id, case when assembly = 'full_file' then p else array_to_string(list_filter([h, case when assembly = 'header_plus_proof' then p else joined end],
 lambda x: {_STRIP("x")} <> ''), chr(10) || chr(10)) || chr(10) end s from m) select record_id, sha256(s) content_hash, length(s)::int chars from s""",
        "proof_repetition": f"""with a as (select record_id, proof, {lines} ls from {_ALL_PROOFS}), b as (select record_id, {code} c, regexp_extract_all(proof, '{token}') t from a),
 g as (select *, list_transform(generate_series(1, len(t) - 2), lambda i: t[i] || chr(1) || t[i + 1] || chr(1) || t[i + 2]) g from b),
 u as (select record_id, unnest(c) x, unnest(generate_series(1, len(c))) i from b), w as (select record_id, x, i - row_number() over (partition by record_id, x order by i) k from u),
 r as (select record_id, max(n) n from (select record_id, count(*) n from w group by record_id, x, k) group by record_id)
 select g.record_id, case when len(c) = 0 then 0.0 else 1 - len(list_distinct(c)) / len(c) end line_repetition_rate,
 case when len(t) < 3 then 0.0 else 1 - len(list_distinct(g)) / len(g) end repeated_trigram_rate,
 case when coalesce(n, 0) > 1 then n else 0 end::int max_consecutive_duplicate_lines from g left join r using (record_id)""",
        "screened_statements": f"""with t as (select task_id, language, {_BARE("concat_ws(chr(10), header, formal_statement)")} b from tasks)
 select task_id, ({_fired(dims.STATEMENT_CLASSES)} + {_ODD_IMPORTS} + ({_GLYPH})::int)::int n_violations from t""",
        "statement_complexity": f"""with h as (select task_id, string_split(formal_statement, ':=')[1] h from tasks),
 b as (select task_id, h, regexp_extract_all(h, '{_re2(dims.BINDER)}', 1) o, list_transform(regexp_extract_all(h, '{_re2(dims.BINDER)}', 3), lambda x: trim(x)) t,
 regexp_extract_all(h, '{_re2(dims.INSTANCE_BINDER)}', 1) ib from h)
 select task_id, (len(o) + len(ib))::int binders, len(list_filter(t, lambda x: regexp_matches(x, '{_re2(dims.PROP_TYPE)}')))::int hypotheses,
 len(list_filter(o, lambda x: x in ('{{', '⦃')))::int implicit_binders, len(ib)::int instance_binders,
 len(regexp_extract_all(regexp_replace(trim(regexp_replace(h, '(?s)^.*(?:{_re2(dims.BINDER)}|{_re2(dims.INSTANCE_BINDER)})', '')), '^\\s*:\\s*', ''), '{token}'))::int conclusion_tokens,
 len(regexp_extract_all(h, '{_re2(dims.QUANTIFIER)}'))::int quantifiers, len(regexp_extract_all(h, '{_re2(dims.CONNECTIVE)}'))::int connectives,
 len(list_distinct(regexp_extract_all(h, '{_re2(dims.QUALIFIED)}', 1)))::int cited_definitions,
 len(list_distinct(list_filter(list_concat(t, ib), lambda x: x <> '')))::int distinct_types, len(regexp_extract_all(h, '{token}'))::int total_tokens,
 coalesce(list_max(list_transform(generate_series(1, len(k)), lambda i: list_reduce(list_prepend(0, list_slice(k, 1, i)),
 lambda d, x: greatest(0, d + x)))), 0)::int max_nesting_depth from (select *, list_transform(regexp_extract_all(h, '[(\\[{{⟨⦃)\\]}}⟩⦄]'), lambda c: case when c in ('(', '[', '{{', '⟨', '⦃') then 1 else -1 end) k from b)""",
        "prover_messages": f"""with c as (select run_id, 'stdout' stream, stdout t from container_runs union all select run_id, 'stderr', stderr from container_runs),
 l as (select run_id, stream, unnest(regexp_split_to_array(t, '\\r\\n|\\n')) raw, unnest(generate_series(1, len(regexp_split_to_array(t, '\\r\\n|\\n')))) i from c where t is not null),
 s as (select run_id, stream, i, {_STRIP("raw")} x, raw from l), g as (select *, regexp_matches(x, '{_re2(dims.PROVER_LINE)}') o, sum(regexp_matches(x, '{_re2(dims.PROVER_LINE)}')::int) over (partition by run_id, stream order by i) k from s),
 m as (select run_id, stream, k, max(case when o then regexp_extract(x, '{_re2(dims.PROVER_LINE)}', 4) end) severity, max(case when o then regexp_extract(x, '{_re2(dims.PROVER_LINE)}', 5) end) f,
 max(case when o then regexp_extract(x, '{_re2(dims.PROVER_LINE)}', 2)::int end) line, string_agg(raw, chr(10) order by i) filter (not o) rest from g where k > 0 group by run_id, stream, k),
 n as (select stream, severity, line, {_cases("f", dims.ERROR_KINDS, "null")} k1, {_cases("f || chr(10) || coalesce(rest, '')", dims.ERROR_KINDS, "'unknown'")} k2 from m)
 select stream, severity, case when severity = 'error' then coalesce(k1, k2) end kind, count(*) n, sum(line)::bigint line_sum from n group by 1, 2, 3""",
        "answers_split": "select t.task_id is not null recognized, count(*) n from results r left join tasks t using (task_id) group by 1",
        "repeated_tactics": """with a as (select task_id, unnest(tactics) tactic, sample_index from results), b as (select task_id, tactic, count(*) n, count(*) filter (sample_index = 0) b from a group by all)
 select task_id, tactic, n - b extra from b where n > b""",
    }

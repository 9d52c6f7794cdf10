import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provelight import dims
from provelight.functions import text as X
from provelight.operators import aggregate as A
from provelight.operators import classify as C
from provelight.operators import measure as M
from provelight.operators import screen as S
from provelight.operators import verdict as V

ODD = ["", " ", "a", "by simp", "a\nb\r\n\nc\u2028d", "h₁simp simp", "αsimp Set.decide x' decide", "(a [b {c} ⟨d⟩)) (", "x := 1 + ", "\ufeffx", "-- c\n/- a\n-/ have h : p := q", "by\n  exact ⟨h, rfl⟩"]


def column(spark, texts, expr):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.select(expr(F.col("t")).alias("o"), "i").orderBy("i").select("o").collect()]


def test_text_helpers_equal_python(spark):
    assert column(spark, ODD, X.lines_of) == [t.splitlines() for t in ODD]
    assert column(spark, ODD, X.strip) == [t.strip() for t in ODD]

    def deepest(t):
        d = best = 0
        for ch in t:
            d = d + 1 if ch in dims.OPENERS else max(0, d - 1) if ch in dims.CLOSERS else d
            best = max(best, d)
        return best

    assert column(spark, ODD, lambda c: X.bracket_depth(c, dims.OPENERS, dims.CLOSERS)) == [deepest(t) for t in ODD]
    for pattern in (dims.TOKEN, dims.QUALIFIED, dims.BRANCH, r"\bsimp\b"):
        want = [len(re.findall(pattern, t)) for t in ODD]
        assert column(spark, ODD, lambda c, p=pattern: X.count_of(c, p)) == want, pattern


def test_tactics(spark):
    word = re.compile(r"(?<![.\w'])([a-zA-Z_][a-zA-Z0-9_'!?]*)")
    want = [[w for w in word.findall(t) if w in dims.LEAN_TACTICS] for t in ODD]
    assert column(spark, ODD, M.tactics) == want
    assert column(spark, ODD, lambda c: M.tactics(c, "unknown")) == [[] for _ in ODD]


def test_structure_by_hand(spark):
    proof = "theorem t : p := by\n  -- note\n  have h1 : a := by simp\n  have h2 : b := f h1\n  simp\n  simp\n  exact Nat.foo h2 -- end"
    df = spark.createDataFrame([(proof,), ("",), (None,)], "p string")
    rows = [r.structure for r in M.add_structure(df, "p").select("structure").collect()]
    s = rows[0]
    assert (s.lines, s.code_lines, s.named_steps, s.local_dependency_depth, s.cited_lemmas) == (7, 6, 2, 3, 1)
    assert (s.line_comments, s.comment_segments, s.auxiliary_declarations, s.declarations) == (2, 2, 0, {"theorem": 1})
    assert s.max_consecutive_duplicate_lines == 2 and not s.term_mode and s.max_nesting_depth == 1
    for empty in rows[1:]:
        assert (empty.chars, empty.lines, empty.tokens, empty.line_repetition_rate, empty.term_mode) == (0, 0, 0, 0.0, False)


def test_statement_by_hand(spark):
    text = "theorem t {α : Type} [Ring α] (n : ℕ) (h : 0 < n) : ∃ m, n ≤ m ∧ Nat.Prime m := by sorry"
    s = M.add_statement(spark.createDataFrame([(text,), (" ",)], "s string"), "s").select("statement_complexity.*").collect()
    assert (s[0].binders, s[0].hypotheses, s[0].implicit_binders, s[0].instance_binders, s[0].distinct_types) == (4, 1, 1, 1, 4)
    assert (s[0].quantifiers, s[0].connectives, s[0].cited_definitions, s[0].conclusion_tokens) == (1, 1, 1, 9)
    assert set(s[1]) == {0}


CAUGHT = {
    "lean.sorry": "lemma half (k : Nat) : 2 ∣ k := by\n  refine ⟨_, sorry⟩",
    "lean.sorry_ax": "def gap : 1 = 2 := sorryAx (1 = 2) false",
    "lean.admit": "lemma later : p ∧ q := by\n  constructor <;> admit",
    "coq.admitted": "Lemma later : forall n, n = n.\nintros. give_up.\nAdmitted.",
    "isabelle.sorry": 'theorem later: "x = x"\n  oops',
    "generic.todo_placeholder": "step 3 is still FIXME",
    "lean.axiom": "@[simp] private axiom wish : 0 = 1",
    "lean.constant": "  constant wish : Nat → Nat",
    "lean.opaque": "opaque hidden (n : Nat) : Nat",
    "coq.assumption_decl": "Parameter wish : nat -> Prop.",
    "isabelle.axiomatization": "consts wish :: nat",
    "lean.native_decide": "example : 97 * 89 = 8633 := by native_decide",
    "lean.skip_kernel_tc": "set_option debug.skipKernelTC true in\nexample : p := q",
    "lean.implemented_by": "@[inline, implemented_by quick] def slow (n : Nat) := n",
    "lean.extern": '@[extern "other_add"] def plus (a b : Nat) := a',
    "lean.unsafe": "unsafe inductive Loop | mk : Loop",
    "lean.partial_def": "partial def spin (n : Nat) := spin (n + 1)",
    "lean.trust_compiler": "exact Lean.ofReduceNat a b rfl",
    "coq.guard_checking": "Unset  Universe Checking.",
    "lean.heartbeats_off": "set_option  maxHeartbeats 0 in",
    "lean.binder_annotations_off": "set_option checkBinderAnnotations false in",
    "lean.auto_implicit": "set_option relaxedAutoImplicit true",
    "lean.structure_eta_off": "set_option backward.synthInstance true",
    "lean.hash_exit": "example : p := q\n  #exit\nnever read",
    "lean.proof_wanted": "proof_wanted fermat (n : Nat) : 2 < n → p n",
    "lean.variable_injection": "variable {K : Type} [Field K]",
    "lean.elab_metaprogramming": "run_cmd logInfo m",
    "lean.compile_time_eval": "#eval 2 + 2",
}


def test_every_screen_rule_catches_its_example_only_in_its_languages(spark):
    rows = [(rule, langs[0], CAUGHT[rule]) for rule, _, langs, _, _ in dims.SCREEN_RULES]
    df = spark.createDataFrame([*rows, ("none", "lean4", "theorem t : p := by simp -- sorry"), ("none", "lean4", None)], "rule string, lang string, src string")
    for r in S.add_violations(df, "src", F.col("lang"), allowed_imports=None).collect():
        found = [re.match(dims.LABEL, v).group(2) for v in r["violations"]]
        assert (r["rule"] in found) if r["rule"] != "none" else found == [], r


def test_statement_checks(spark):
    data = [
        ("theorem t (n : Foo.Bar) : n = n := by rfl", "theorem t (n : Foo.Bar) : n = n := by", []),
        ("theorem t (n : Foo.Bar) : True := trivial", "theorem t (n : Foo.Bar) : n = n := by", ["generic.statement_altered"]),
        ("def Foo.Bar := 1\ntheorem t (n : Foo.Bar) : n = n := by rfl", "theorem t (n : Foo.Bar) : n = n", ["lean.redefines_statement_term"]),
        ("open Evil.Bar\nnotation x\ntheorem t (n : Foo.Bar) : n = n", "theorem t (n : Foo.Bar) : n = n", ["lean.notation_redefinition", "lean.open_shadows_statement"]),
        ("import Evil\ntheorem t : x := y", None, ["lean.unknown_import"]),
        ("theorem Nаt : x := y", None, ["generic.homoglyph_identifier"]),
    ]
    df = spark.createDataFrame(data, "src string, req string, want array<string>")
    for r in S.add_violations(df, "src", F.lit("lean4"), F.col("req")).collect():
        assert [re.match(dims.LABEL, v).group(2) for v in r["violations"]] == r["want"], r


def test_what_a_source_inherited_is_no_finding(spark):
    base = "variable (N : Nat)\n  (M : Nat)\naxiom old : True"
    data = [
        ("variable (N : Nat)\n   (M : Nat)\ntheorem t : x := y", base, []),
        ("variable (h : False)\ntheorem t : x := y", base, ["lean.variable_injection"]),
        ("variable (N : Nat) (M : Nat)\nvariable (N : Nat) (M : Nat)", base, ["lean.variable_injection"]),
        ("axiom old : True\nopaque f : Nat", base, ["lean.opaque"]),
        ("axiom old : True", None, ["lean.axiom"]),
    ]
    df = spark.createDataFrame(data, "src string, base string, want array<string>")
    for r in S.add_violations(df, "src", F.lit("lean4"), None, baseline=F.col("base")).collect():
        assert [re.match(dims.LABEL, v).group(2) for v in r["violations"]] == r["want"], r


def test_judge_prompt(spark):
    from provelight.plans.grade import judge_prompt

    df = spark.createDataFrame([("a", "b", " "), (None, "b", "g")], "i string, f string, g string")
    got = [r[0] for r in df.select(judge_prompt(F.col("i"), F.col("f"), "R", F.col("g"))).collect()]
    assert got[0] == "R\n\nInformal statement:\na\n\nFormal statement:\nb" and got[1].endswith("formalization:\ng") and "Informal" not in got[1]


def test_axioms_imports_and_multisets(spark):
    df = spark.createDataFrame([(["propext"],), (["sorryAx", "b", "b", "Lean.ofReduceBool"],), ([],), (None,)], "a array<string>")
    got = [r[0] for r in df.select(F.transform(S.axiom_violations(F.col("a")), lambda v: S.label_parts(v)[1])).collect()]
    assert got == [[], ["kernel.compiler_trust", "kernel.nonstandard_axiom", "kernel.sorry_ax"], [], ["kernel.audit_missing"]]
    one = spark.createDataFrame([(["Mathlib", "Mathlib.X", "Mathlibx", "P.Q", "P.Q.Goal"],)], "m array<string>")
    assert one.select(S.foreign_imports(F.col("m"), ["Mathlib"], F.lit("P.Q"))).first()[0] == ["Mathlibx", "P.Q.Goal"]
    theirs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a")], "k int, x string")
    base = spark.createDataFrame([(1, "a"), (2, "a")], "k int, x string")
    assert {tuple(r) for r in S.multiset_excess(theirs, base, ["k"], "x").collect()} == {(1, "a", 1), (1, "b", 1)}


def test_error_kinds_and_truncation(spark):
    messages = ["Unknown Identifier 'x'", "unsolved goals\nh", "(deterministic) timeout at whnf", "unexpected token 'at'; expected term", "linarith failed", "type mismatch", "what"]
    assert column(spark, messages, C.error_kind) == ["unknown_identifier", "unsolved_goals", "resource_limit", "syntax", "tactic_failed", "type", "unknown"]
    assert column(spark, ["by simp [", "by exact", "have h :=  ", "by omega", "", "f (x", ")("], C.looks_truncated) == [True, True, True, False, False, True, False]


def test_prover_log(spark):
    log = "noise\nA.lean:1:2: error: first\n  more\n\nB b.lean:3:4: warning(k.l): second\nA.lean:5:6: error: odd\nunsolved goals\n"
    df = spark.createDataFrame([(1, log), (2, ""), (3, None), (4, "noise")], "id int, log string")
    got = [tuple(r) for r in C.parse_prover_log(df, ["id"], "log").orderBy("id", "ordinal").collect()]
    assert got == [
        (1, 1, "error", "first\n  more", 1, 2, "unknown"),
        (1, 2, "warning", "second", 3, 4, None),
        (1, 3, "error", "odd\nunsolved goals", 5, 6, "unsolved_goals"),
    ]
    listing = "'a' depends on axioms: [propext, x]\n'b' does not depend on any axioms\n'c' depends on axioms: [q]\n'c' depends on axioms: [q]"
    one = spark.createDataFrame([(listing, n) for n in "abcd"], "l string, n string")
    assert [r[0] for r in one.select(C.printed_axioms(F.col("l"), F.col("n"))).collect()] == [["propext", "x"], [], None, None]


def test_verdicts_keep_what_is_not_known(spark):
    check = "array<struct<kind: string, passed: boolean, detail: string, fatal: boolean>>"
    data = [(None,), ([],), ([("k", None, "", True)],), ([("k", None, "", True), ("k", True, "", False)],), ([("k", False, "", True), ("k", True, "", False)],), ([None, ("k", False, "", False)],)]
    df = spark.createDataFrame(data, f"c {check}")
    got = [tuple(r) for r in df.select(V.statement_status(F.col("c")), V.health(F.col("c"))).collect()]
    assert got == [("inconclusive", "unprobed")] * 3 + [("ok", "clean"), ("unfaithful", "ungradeable"), ("unfaithful", "suspect")]
    votes = spark.createDataFrame([(["a", "b", "a"],), (["a", "b"],), ([None],), (None,)], "s array<string>")
    assert [r[0] for r in votes.select(V.consensus(F.col("s"))).collect()] == ["a", "unsure", None, None]
    twice = spark.createDataFrame([(["faithful", "unfaithful", "unfaithful"], ["faithful", "faithful"]), (["faithful"], ["unfaithful"] * 3), (["unfaithful"], None)], "a array<string>, b array<string>")
    assert [r[0] for r in twice.select(V.consensus_rechecked(F.col("a"), F.col("b"))).collect()] == ["faithful", "faithful", "unfaithful"]
    sure = spark.createDataFrame([([("a", 0.5), ("a", None), ("b", 0.1), ("a", 1.0)],), ([],)], "s array<struct<label: string, confidence: double>>")
    assert [r[0] for r in sure.select(V.agreeing_confidence(F.col("s"), F.lit("a"))).collect()] == [0.75, None]
    faults = "array<struct<fault: string, detail: string>>"
    rows = spark.createDataFrame([([], "verified", True), ([], "verified", None), ([], None, None), ([("x", "")], "verified", True), ([], "failed", None), ([], "verified", False)], f"f {faults}, b string, a boolean")
    none = F.array().cast("array<struct<stage: string, status: string>>")
    out = rows.select(V.solved(F.col("f"), F.col("b"), F.col("a")), V.refused_at(F.col("f"), none, F.col("b"), F.lit(None).cast("string"), F.col("a")))
    assert [tuple(r) for r in out.collect()] == [(True, None), (False, None), (False, None), (False, "interface"), (False, "kernel"), (False, "axioms")]


def test_draw_equals_hashlib(spark):
    import hashlib

    texts = ["", "a", "é", "by simp"]
    want = [int.from_bytes(hashlib.sha256(("s" + t).encode()).digest()[:8], "big") / float(1 << 64) for t in texts]
    assert column(spark, texts, lambda c: V.draw("s", c)) == pytest.approx(want, rel=1e-12)


def test_aggregates_of_nothing_and_of_constants(spark):
    df = spark.createDataFrame([], "tactics array<string>, status string, x double, model string, mode string, task string, t string")
    v, s = A.outcome(F.col("status"))
    assert A.tactic_frequency(df, "tactics", v, s).count() == 0
    assert A.tactic_totals(df, "tactics").first()["proofs_measured"] == 0
    assert A.sample_duplication(df, "task", F.col("t")).first()["mean_duplicate_fraction"] == 0.0
    same = spark.createDataFrame([(1.0, True), (1.0, False), (1.0, True)], "x double, y boolean")
    assert A.correlations(same, {"x": F.col("x")}, F.col("y"), F.lit(True)).count() == 0
    two = spark.createDataFrame([(1.0, True), (2.0, False), (3.0, False)], "x double, y boolean")
    r = A.correlations(two, {"x": F.col("x")}, F.col("y"), F.lit(True)).first()
    assert r["r"] == pytest.approx(-0.8660254) and r["strength"] == "strong" and r["direction"] == "negative"
    d = A.distribution(spark.createDataFrame([("a", 5.0)], "g string, x double"), ["g"], "x").first()
    assert (d["stdev"], d["median"], d["p90"], d["total"]) == (0.0, 5.0, 5.0, 5.0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " a", ""]), max_size=8), st.text(alphabet="([{)]}⟨⟩ ab1.", max_size=30))
def test_scan_equals_counting(lines, more):
    from provelight.functions.lean import scan

    text = "\n".join(lines) + "\n" + more
    full = [x.strip() for x in text.splitlines() if x.strip()]
    best = run = 0
    for i, x in enumerate(full):
        run = run + 1 if i and full[i - 1] == x else 1
        best = max(best, run)
    depth = deepest = 0
    for ch in text:
        depth = depth + 1 if ch in dims.OPENERS else max(0, depth - 1) if ch in dims.CLOSERS else depth
        deepest = max(deepest, depth)
    tokens = re.findall(dims.TOKEN, text)
    got = scan(text)
    assert (got.run, got.brackets, got.tokens) == (best if best > 1 else 0, deepest, len(tokens))
    assert got.trigrams == len({tuple(tokens[i : i + 3]) for i in range(len(tokens) - 2)})

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from provelight import cli
from provelight.plans import grade as G
from provelight.sources import folders as D
from provelight.sources import records as R
from provelight.sources import runs as W
from provelight.streaming import stage_log as T

PROBLEM = "/-!\n- source: Book\n- Notes: a: b\n- source: second\n-/\nimport Mathlib\nnamespace Problem\ndef Target : Prop := ∀ n : ℕ, n = n\nend Problem\n"
VALUE = "namespace Problem\ndef Target (a : ℕ) : Prop := a = 4\nend Problem\n"
GOOD = "import Mathlib\nimport Bench.p1\nnamespace Submission\ntheorem helper : True := trivial\ntheorem solution : Problem.Target := by\n  intro n\n  rfl -- MOCK_PASS\nend Submission\n"
ANSWERS = {
    "good": GOOD,
    "sorry": GOOD.replace("intro n\n  rfl", "sorry"),
    "half": GOOD.replace("trivial", "by sorry"),
    "axiom": GOOD.replace("theorem helper : True := trivial", "axiom helper : True"),
    "missing": GOOD.replace("solution", "other"),
    "outside": "theorem stray : True := trivial\n" + GOOD,
    "inproblem": GOOD + "namespace Problem\ndef x := 1\nend Problem\n",
    "binders": GOOD.replace("solution :", "solution (n : ℕ) :"),
    "syntax": GOOD.replace("theorem helper", 'notation "x" => 1\ntheorem helper'),
    "attribute": GOOD.replace("theorem helper", "attribute [simp] Nat.add\ntheorem helper"),
    "imports": GOOD.replace("import Mathlib", "import Evil.Twin"),
    "fails": GOOD.replace("MOCK_PASS", "MOCK_UNSOLVED"),
}
REFUSALS = {
    "good": None, "sorry": "solution_unproved", "half": "incomplete_proof", "axiom": "reward_hacking", "missing": "solution_missing",
    "outside": "declaration_outside_namespace", "inproblem": "problem_namespace_reused", "binders": "solution_binders",
    "syntax": "syntax_extension", "attribute": "imported_attribute", "imports": "import_not_allowed", "fails": None,
}


@pytest.fixture()
def bench(tmp_path):
    (tmp_path / "b" / "problems").mkdir(parents=True)
    (tmp_path / "b" / "problems" / "p1.lean").write_text(PROBLEM)
    (tmp_path / "b" / "problems" / "p2.lean").write_text(VALUE)
    (tmp_path / "b" / "benchmark.json").write_text(json.dumps({"name": "n", "toolchain": {"lean": "v4"}, "policy": {"allowed_imports": ["Mathlib"]}}))
    for name, text in ANSWERS.items():
        (tmp_path / "s" / name).mkdir(parents=True)
        (tmp_path / "s" / name / "p1.lean").write_text(text)
    (tmp_path / "s" / "idle").mkdir()
    (tmp_path / "s" / "good" / "README.md").write_text("x")
    (tmp_path / "s" / "good" / "p9.lean").write_text("x")
    (tmp_path / "s" / "good" / "other.txt").write_text("x")
    return tmp_path


def test_folders(spark, bench):
    problems = D.read_problems(spark, str(bench / "b"))
    assert sorted(r["problem_id"] for r in problems.collect()) == ["p1", "p2"]
    got = D.read_submissions(spark, str(bench / "s"), problems)
    assert got.answers.count() == len(ANSWERS) and "idle" in got.participants
    assert sorted(tuple(r) for r in got.unrecognized.collect()) == [("good", "other.txt"), ("good", "p9.lean")]
    meta = {r["problem_id"]: r for r in D.problem_metadata(problems).collect()}
    assert meta["p1"]["declared_source"] == "Book" and meta["p1"]["notes"] == "a: b" and meta["p1"]["has_provenance"]
    assert meta["p1"]["theorem_name"] == "Problem.Target" and not meta["p2"]["has_provenance"]
    manifest = D.read_manifest(str(bench / "b" / "problems"))
    assert manifest.name == "n" and manifest.policy.allowed_imports == ("Mathlib",) and manifest.declares_toolchain
    assert D.read_manifest(str(bench / "s")).name == ""
    assert D.environment_mismatches(manifest, {}) and not D.environment_mismatches(manifest, {"lean": "v4"})
    for policy in ({"x": 1}, {"allowed_imports": "M"}, {"require_replay": 1}, []):
        with pytest.raises(ValueError):
            D.Manifest(raw={"policy": policy}).policy
    with pytest.raises(ValueError):
        D.read_problems(spark, str(bench / "s"))
    with pytest.raises(FileNotFoundError):
        D.read_problems(spark, str(bench / "nowhere"))
    with pytest.raises(ValueError):
        D.freeze(problems.unionByName(problems), str(bench / "frozen"))


def test_grading(spark, bench):
    problems = D.read_problems(spark, str(bench / "b"))
    subs = D.read_submissions(spark, str(bench / "s"), problems)
    folder, made = G.run(str(bench / "runs"), problems, subs, G.create("mock"), D.read_manifest(str(bench / "b")).policy, "r1")
    rows = {r["participant"]: r for r in spark.read.parquet(str(folder.root / "graded")).collect()}
    assert {p: (r["faults"][0]["fault"] if r["faults"] else None) for p, r in rows.items()} == REFUSALS
    assert [p for p, r in rows.items() if r["solved"]] == ["good"]
    assert rows["good"]["success_mode"] == "auxiliary_lemmas" or rows["good"]["success_mode"] == "short_tactic_chain"
    assert rows["sorry"]["failure_mode"] == "placeholder_left" and rows["axiom"]["failure_mode"] == "reward_hacking"
    assert rows["fails"]["refused_at"] == "kernel" and rows["fails"]["kernel"] == "failed"
    total = made.summary.first()
    assert (total["problems"], total["participants"], total["answers"], total["solved"], total["kernel_checked"]) == (2, 13, 12, 1, 2)
    board = made.leaderboard.collect()
    assert len(board) == 13 and board[0]["participant"] == "good"
    assert {r["problem_id"]: r["attempted"] for r in made.by_problem.collect()} == {"p1": 12, "p2": 0}
    assert {(r["class"], r["rule"]) for r in made.hacks.collect()} == {("new_axiom", "lean.axiom")}
    assert folder.state()["state"] == "complete" and (folder.root / "leaderboard.tsv").read_text().startswith("rank\tparticipant")
    with pytest.raises(FileExistsError):
        W.RunFolder(str(bench / "runs"), "r1")
    assert "more" in W.text_table(made.leaderboard, 3)


def test_run_events_and_a_run_that_stops(spark, bench):
    problems = D.read_problems(spark, str(bench / "b"))
    subs = D.read_submissions(spark, str(bench / "s"), problems)
    folder, _ = G.run(str(bench / "runs"), problems, subs, G.create("mock"), D.read_manifest(str(bench / "b")).policy, "events")
    last = {(r["participant"], r["stage"]): r["status"] for r in folder.snapshot(spark).collect()}
    assert len(last) == 5 * len(ANSWERS) and folder.unfinished(spark).isEmpty()
    assert [last["good", s] for s in ("interface", "kernel", "replay", "axioms")] == ["passed", "passed", "not_run", "failed"] or last["good", "axioms"] == "passed"
    assert last["axiom", "interface"] == "failed" and last["axiom", "kernel"] == "not_run" and last["fails", "kernel"] == "failed"

    def stops(answers):
        raise RuntimeError("the prover is gone")

    with pytest.raises(RuntimeError):
        G.run(str(bench / "runs"), problems, subs, stops, None, "stopped")
    left = W.RunFolder.__new__(W.RunFolder)
    left.root = bench / "runs" / "stopped"
    assert left.state()["state"] == "failed" and {r["stage"] for r in left.events(spark).collect()} == {"interface"}


def test_policy_of_instances_and_replay(spark, bench):
    problems = D.read_problems(spark, str(bench / "b"))
    source = GOOD.replace("theorem helper", "instance : Inhabited Nat := ⟨0⟩\ntheorem helper")
    answers = spark.createDataFrame([("a", "p1", source), ("b", "p1", GOOD)], "participant string, problem_id string, source string")
    faults = lambda p: {r["participant"]: [f["fault"] for f in r["faults"]] for r in G.screened(answers, problems, p).collect()}
    assert faults(D.Policy()) == {"a": [], "b": []}
    assert faults(D.Policy(allow_global_instances=False)) == {"a": ["instance_not_allowed"], "b": []}
    with pytest.raises(ValueError):
        D.Policy(isolate_builds=False)
    builds = spark.createDataFrame(
        [("a", "p1", "verified", None, ["propext"], None, 1.0, [("kernel", "passed"), ("replay", "passed")]), ("b", "p1", "verified", None, ["propext"], None, 1.0, None)],
        G.BUILD + f", stages {G.STAGE}",
    )
    rows = {r["participant"]: r for r in G.grade(answers, problems, G.create("replay", builds=builds), D.Policy(require_replay=True)).collect()}
    assert rows["a"]["solved"] and not rows["b"]["solved"] and rows["b"]["refused_at"] == "replay"


def test_health_of_problems(spark):
    rows = [("clean", "theorem t : p", "lean4", "g"), ("broken", "theorem t : q", "lean4", None), ("easy", "theorem t : r", "lean4", None), ("vacuous", "theorem t (h : x) : r", "lean4", None), ("assumes", "axiom a : False", "lean4", None), ("unasked", "theorem t : s", "lean4", None), ("failed", "theorem t : u", "lean4", None)]
    tasks = spark.createDataFrame(rows, "task_id string, formal_statement string, language string, gold_formal_statement string").withColumn("header", F.lit(""))
    probes = [("clean", "elaborates", "verified"), ("clean", "gold_equivalent", "verified"), ("clean", "trivial", "failed"), ("broken", "elaborates", "failed"), ("broken", "vacuous", "verified"), ("easy", "elaborates", "verified"), ("easy", "trivial", "verified"), ("vacuous", "elaborates", "verified"), ("vacuous", "vacuous", "verified"), ("failed", "elaborates", "error")]
    got = {r["task_id"]: r for r in G.problem_health(tasks, spark.createDataFrame(probes, "task_id string, probe string, status string")).collect()}
    state = {k: r["state"] for k, r in got.items()}
    assert state == {"clean": "clean", "broken": "ungradeable", "easy": "clean", "vacuous": "ungradeable", "assumes": "ungradeable", "unasked": "clean", "failed": "clean"}
    checks = {c["kind"]: c["passed"] for c in got["clean"]["checks"]}
    assert checks == {"assumes_nothing": True, "elaborates": True, "non_trivial": None, "non_vacuous": None, "gold_equivalent": True}
    assert {c["kind"]: c["passed"] for c in got["broken"]["checks"]} == {"assumes_nothing": True, "elaborates": False, "non_trivial": None, "non_vacuous": None}


def test_replayed_builds(spark, bench):
    problems = D.read_problems(spark, str(bench / "b"))
    answers = D.read_submissions(spark, str(bench / "s"), problems).answers
    builds = spark.createDataFrame([("good", "p1", "verified", None, ["propext", "sorryAx"], None, 1.5), ("fails", "p1", "verified", None, None, None, 2.0)], G.BUILD)
    rows = {r["participant"]: r for r in G.grade(answers.where("participant in ('good', 'fails')"), problems, G.create("replay", builds=builds), D.Policy()).collect()}
    assert rows["good"]["refused_at"] == "axioms" and rows["good"]["failure_mode"] == "placeholder_left"
    assert rows["fails"]["refused_at"] is None and not rows["fails"]["solved"] and rows["fails"]["failure_mode"] == "harness_error"


def test_probes_and_judges(spark):
    data = [
        ("a", "prose", "theorem t (n : ℕ) (h : 0 < n) : n = n := by", "lemma g (n : ℕ)  (h : 0 < n) : n ≤ n", "import Mathlib", None),
        ("b", " ", "theorem u : True", None, None, {"mock_judge": "faithful"}),
        ("c", "p", "def x := 1", None, "", {"mock_judge": "Unsure"}),
        ("d", "p", None, None, "", None),
    ]
    df = spark.createDataFrame(data, "task_id string, informal_statement string, formal_statement string, gold_formal_statement string, header string, metadata map<string,string>")
    got = {r["task_id"]: r for r in G.add_probes(df).collect()}
    assert got["a"]["trivial"].startswith("import Mathlib\n\ntheorem trivial_probe (n : ℕ) (h : 0 < n) : n = n := by\n  first | trivial")
    assert ": False :=" in got["a"]["vacuous"] and "(n = n) ↔ (n ≤ n)" in got["a"]["gold_equivalent"]
    assert got["b"]["elaborates"] == "theorem u : True := sorry\n" and got["b"]["vacuous"] is None and got["b"]["gold_equivalent"] is None
    assert got["c"]["trivial"] is None and got["d"]["elaborates"] is None
    labels = {r["task_id"]: r["label"] for r in G.judges.create("mock")(df).collect()}
    assert labels == {"a": "unsure", "b": None, "c": "unsure", "d": "unsure"}


def test_command_line(spark, bench, capsys):
    base = [str(bench / "b"), str(bench / "s"), "--out", str(bench / "out")]
    assert cli.main(["grade", *base, "--strict", "--option", "pass_rate=0.5"]) == 5
    assert cli.main(["audit", str(bench / "b")]) == 0 and "Problem.Target" in capsys.readouterr().out
    assert cli.main(["verifiers"]) == 0 and cli.main(["judges"]) == 0
    assert cli.main(["health", str(bench / "b"), "--strict"]) == 0 and "clean" in capsys.readouterr().out
    assert cli.main(["doctor", str(bench / "b")]) == 5 and "declared v4" in capsys.readouterr().out
    assert cli.main(["grade", *base, "--verifier", "none"]) == 2
    assert cli.main(["audit", str(bench / "nowhere")]) == 2


def test_names():
    for bad in ("", ".", "..", "a/b", " a", "a.", "a:b"):
        with pytest.raises(ValueError):
            W.safe_name(bad)
    assert W.safe_name(W.new_run_id().replace(":", ""))


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('// note\n\n{"task_id": "t", "sample_index": 2, "proof": "x", "odd": {"a": 1}}\n  {"task_id": "u", "metadata": {"k": "v"}}\n')
    rows = R.read_jsonl(spark, str(path), "attempts").orderBy("task_id").collect()
    assert [(r["task_id"], r["sample_index"], r["metadata"]) for r in rows] == [("t", 2, {"odd": '{"a":1}'}), ("u", None, {"k": "v"})]
    assert R.fill_attempt_ids(R.read_jsonl(spark, str(path), "attempts")).where("attempt_id = 't#2'").count() == 1
    array = tmp_path / "b.json"
    array.write_text('\n[{"task_id": "t"}, {"task_id": "u"}]')
    assert R.read_jsonl(spark, str(array), "tasks").count() == 2
    for bad in ('{"a": 1}\n{"b": ', "[1]", '{"a": 1}\n5\n'):
        path.write_text(bad)
        with pytest.raises(R.BadRecord):
            R.read_jsonl(spark, str(path))
    df = spark.createDataFrame([("t", -1, "p"), (" ", 0, "p"), ("t", None, None)], "task_id string, sample_index int, proof string")
    good, bad = R.validate(df, "attempts")
    assert good.count() == 1 and {tuple(r["problems"]) for r in bad.collect()} == {("sample_index",), ("task_id",)}
    assert R.write_jsonl(df, str(tmp_path / "out")) == 3
    assert R.read_jsonl(spark, str(tmp_path / "out"), "attempts").count() == 3


def events():
    at = lambda h, m=0: datetime(2026, 1, 1, h, m).isoformat()
    rows = [("a", "p", "kernel", "running", "", at(1), 1), ("a", "p", "kernel", "failed", "x", at(1, 5), 2), ("b", "p", "interface", "running", "", at(2), 3), ("b", "p", "interface", "passed", "", at(2), 4)]
    names = [f.split(" ")[0] for f in T.EVENT_SCHEMA.split(", ")]
    return [dict(zip(names, r, strict=True)) for r in rows]


def test_stage_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i, e in enumerate(events()):
        (source / f"{i}.json").write_text(json.dumps(e))
    seen = []
    for _ in range(2):  # the second start finds nothing new
        T.upsert_snapshot(T.read_events(spark, str(source), 1), str(tmp_path / "snap"), str(tmp_path / "ck"), lambda b, n: seen.append(n)).awaitTermination()
    got = {(r["participant"], r["stage"]): r["status"] for r in T.read_snapshot(spark, str(tmp_path / "snap")).collect()}
    assert got == {("a", "kernel"): "failed", ("b", "interface"): "passed"} and seen == [0, 1, 2, 3]
    batch = spark.read.schema(T.EVENT_SCHEMA).json(str(source))
    assert {(r["participant"], r["status"]) for r in T.latest(batch).collect()} == {("a", "failed"), ("b", "passed")}
    assert sum(r["n"] for r in T.tumbling_counts(batch).collect()) == 4
    behind = T.next_stages(batch).where("status = 'not_run'")
    assert sorted(r["stage"] for r in behind.collect()) == ["axioms", "dependencies", "replay"]


def test_run_folder_events(spark, tmp_path):
    folder = W.RunFolder(str(tmp_path), "r")
    frame = spark.createDataFrame([tuple(e.values()) for e in events()], T.EVENT_SCHEMA.replace("recorded_at timestamp", "recorded_at string")).withColumn("recorded_at", F.to_timestamp("recorded_at"))
    folder.append_events(frame.where("ordinal < 2"))
    assert folder.unfinished(spark).count() == 1
    folder.append_events(frame.where("ordinal >= 2"))
    assert folder.unfinished(spark).count() == 0 and folder.refused(spark).count() == 1

"""The screening of statements on tasks that do hold violations."""

from provelight.plans import analysis_queries as Q


def test_violations_are_counted(spark, tmp_path):
    rows = [
        ("clean", "lean4", "import Mathlib", "theorem t (n : Nat) : n = n := by"),
        ("header", "lean4", "axiom cheat (n : Nat) : n = n", "theorem t (n : Nat) : n = n := by"),
        ("own", "lean4", "", "opaque cheat : Nat"),
        ("other", "coq", "", "Axiom cheat : True."),
    ]
    spark.createDataFrame(rows, "task_id string, language string, header string, formal_statement string").write.parquet(f"{tmp_path}/tasks.parquet")
    got = {r["task_id"]: r["n_violations"] for r in Q.screened_statements(spark, str(tmp_path)).collect()}
    assert got == {"clean": 0, "header": 1, "own": 1, "other": 1}

"""Every attempt is graded, whether its model is known or not."""

from provelight.plans import pipeline_queries as Q


def test_attempts_without_a_model_are_graded(spark, tmp_path):
    spark.createDataFrame([("t", "theorem t (n : Nat) : n = n := by")], "task_id string, formal_statement string").write.parquet(f"{tmp_path}/tasks.parquet")
    rows = [("m", 1, "t", "theorem t (n : Nat) : n = n := rfl"), (None, 2, "t", "theorem t (n : Nat) : n = n := rfl"), (None, 3, "t", None)]
    spark.createDataFrame(rows, "model string, record_id bigint, task_id string, proof string").write.parquet(f"{tmp_path}/attempts.parquet")
    assert sorted(r["participant"] for r in Q.graded(spark, str(tmp_path)).select("participant").collect()) == ["(no model)#2", "(no model)#3", "m#1"]
